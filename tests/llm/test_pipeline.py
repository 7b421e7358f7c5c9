import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brute import lines_kept, near_kept
from graphlode.llm.common import staged
from graphlode.llm.quality import with_ids

SF = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    states = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        states.append(docs.collect())
        assert name == "packing" or docs.columns == COLUMNS
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = [{r.doc_id: r.text for r in s} for s in states[:-1]]
    kept = texts[1]
    known = [labels[i].quality for i in kept if i in labels]
    assert known and sum(known) == len(known)
    assert texts[2] == kept
    assert texts[3] == lines_kept(texts[2])
    assert set(texts[4]) == near_kept(texts[3])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {}
    for r in states[5]:
        assert len(r.ids) == r.length
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts[4].items()}


def test_no_stage_holds_two_workers_a_core(spark, docs):
    ids = staged(spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long"), "ids")
    found = with_ids(docs, ids)
    assert sorted(r.text for r in found.collect() if r.text) == sorted(r.text for r in docs.where("doc_id < 40 and doc_id % 3 = 0").collect() if r.text)
    read = found.mapInArrow(lambda batches: batches, "text string")
    read.collect()
    plan = read._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for part in plan.split("Exchange"):  # what runs in one task
        assert part.count("MapInArrow") <= 1, plan


def test_empty(spark, no_docs):
    docs = no_docs.select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.select(*COLUMNS)
    texts = dict(enumerate(r.text for r in docs.collect()))
    stages = dict(corpus_pipeline.STAGES)
    long = [t for t in texts.values() if len((t or "").split()) >= 50]
    assert {r.text for r in stages["quality"](spark, docs, SF).collect()} <= set(long)
    lettered = [t for t in texts.values() if any(map(str.isalpha, t or ""))]
    told = [r.text for r in stages["language"](spark, docs, SF).collect()]
    assert set(told) <= set(lettered) and {t for t in lettered if len(t.split()) < 15} <= set(told)
    assert stages["line_dedup"](spark, docs, SF).count() == len(texts)
    kept = [r.text for r in stages["near_duplicates"](spark, docs, SF).collect()]
    assert len(kept) == len(near_kept(texts)) and set(kept) == set(texts.values())
    packed = stages["packing"](spark, docs, SF).collect()
    assert sum(r.length for r in packed) == sum(len(r.ids) for r in packed) and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert sum(r.piece == 0 for r in packed) == len(texts)


def test_near_copies_of_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = b.replace("b30", "changed")
    rows = [(1, a), (2, a), (2, b), (3, near), (3, c), (4, c), (4, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.text for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()]
    assert len(got) == 3 and a in got and c in got and (b in got) != (near in got)


def test_language_stage_rejects_what_no_language_covers(spark):
    rng = random.Random(5)
    vocabulary = {"en": ["the", "house", "thing", "with", "water", "ring"], "de": ["der", "haus", "dinge", "wasser", "mit", "über"]}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=40)), lang) for i, lang in enumerate(["en", "de"] * 50)]
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60))
    rows += [(1000, noise, None), (1001, "talossa on punainen katto ja vanha ovi " * 8, None), (1002, "12 34", None), (1003, "talo", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], schema)
    stage = dict(corpus_pipeline.STAGES)["language"]
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == {*range(100), 1003}
    untold = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in stage(spark, untold, SF).collect()} == {*range(100), 1000, 1001, 1003}


def test_near_copies_without_id(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(3)]
    near = texts[0].replace(texts[0].split(" ")[40], "changed")
    rows = [(None, texts[0]), (None, texts[0]), (None, near), (7, texts[1]), (None, texts[1]), (None, texts[2]), (2**63 - 1, "one two three four five six")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    for part in (rows, rows[:-1], [r for r in rows if r[0] is None]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in part], schema)
        got = [(r.doc_id, r.text) for r in stage(spark, docs, SF).collect()]
        assert len(got) == len(part) - 3 + (len(part) == 5)
        assert sum(t in (texts[0], near) for _, t in got) == 1 and (None, texts[2]) in got
        assert [i for i, t in got if t == texts[1]] == ([7] if (7, texts[1]) in part else [None])
