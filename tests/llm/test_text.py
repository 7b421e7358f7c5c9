import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from graphlode.llm.html_text import extract, main_text, mark_shared, page_lines, shared_lines
from graphlode.llm.language import coverage_floor, fit, held_out, identify, language_id, sampled
from graphlode.llm.quality import quality_rules, threshold_of
from graphlode.llm.warc import parse, read_archives, read_record, write_archives

WORD = re.compile("[^\x20\x09-\x0d]+")
PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/a">Menu</a></ul></nav>
<header>Site</header><div class="ad">Buy</div><!-- <p>no</p> --><article><header><h1>Head  line</h1></header><p><b>One &lt;two&gt;<br>three &amp;amp;<p>Four<div class="user-comments"><p>Nice!</div>
<form><input><p>Name</p></form><ul><li>first<li>second</ul></article><aside>See</aside><footer>&copy; us</footer>"""


def test_page_text():
    assert main_text(page_lines(PAGE)) == "Head line\n\nOne <two> three &amp;\n\nFour\n\nfirst\n\nsecond"
    assert main_text(page_lines("")) == "" and main_text(page_lines("<p>a <i>b</i>\n c")) == "a b c"
    assert main_text(page_lines('<article><p class="cookie-notice">We use<p>Text<h2 id=share>Share</h2>end</article>')) == "Text\n\nend"
    assert main_text(page_lines("a < b <3 &lt;p&gt;")) == "a < b <3 <p>"


def test_template_lines_go():
    pages = [page_lines(f"<div>Site menu</div><div>Story {i} here</div><div>About us</div>") for i in range(2)]
    mark_shared(pages[0], pages[1])
    assert main_text(pages[0]) == "Story 0 here"


def test_shared_lines_are_a_longest_common_subsequence():
    def lcs(x, y):
        d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                d[i + 1][j + 1] = d[i][j] + 1 if a == b else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(0)
    for _ in range(500):
        a, b = (["abcd"[rng.randrange(4)] for _ in range(rng.randint(0, 9))] for _ in range(2))
        for most in (1 << 28, 0, 20):
            got = sorted(shared_lines(a, b, most))
            rest = iter(b)
            assert len(got) == lcs(a, b) and all(a[i] in rest for i in got)


def test_long_pages():
    a, b = ([f"line {x} {i}" for i in range(30_000)] for x in "ab")
    a[::100] = b[::100] = [f"both {i}" for i in range(300)]
    assert sorted(shared_lines(a, b, 1 << 26)) == list(range(0, 30_000, 100))
    deep = "<div>" * 50_000 + "text" + "</span></section>" * 50_000 + "</div>" * 50_000
    assert main_text(page_lines(deep)) == "text"


def test_extract(spark):
    rows = [(1, "http://h.x/a/1", PAGE), (2, "http://h.x/a/2?q", PAGE.replace("Four", "Five")), (3, None, PAGE), (4, "http://alone.x/", None), (None, "nothing", ""), (6, "http://p.x/1", "<div>M</div><div>S1</div>"), (7, "http://p.x/2", "<div>M</div><div>S2</div>")]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(pages.coalesce(1)).collect()}
    assert len(got) == 7 and got[4][1] == "" and got[None][1] == ""
    assert "Four" in got[1][1] and "Five" in got[2][1] and got[3][1] == got[1][1]
    assert all(len(t) == n for _, t, n in got.values())
    assert extract(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/", "same"), (3, "http://b/\n", "same"), (9, None, "é" * 1000), (None, "http://c/", "same"), (7, "u", None), (8, "u", ""), (8, "v", "")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string")
    manifest = write_archives(pages, path=str(tmp_path / "w"), frame_bytes=300)
    got = sorted(((r.page_id if r.page_id is not None else -1), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read_archives(spark, str(tmp_path / "w")).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == [
        (-1, "response", None, 4, digest("same")), (3, "response", None, 4, digest("same")), (5, "revisit", 3, 4, digest("same")), (7, "response", None, 0, digest("")),
        (8, "revisit", 7, 0, digest("")), (8, "revisit", 7, 0, digest("")), (9, "response", None, 2000, digest("é" * 1000)),
    ]
    held = [r.path for r in manifest.collect()]
    found = []
    for path in held:
        data = open(path, "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        at = 0
        while at < len(plain):
            head, _, at = parse(plain, at)
            found.append(head["WARC-Type"])
    assert Counter(found) == {"response": 4, "revisit": 3}
    for path in held:
        try:
            head, payload = read_record(path, 9)
        except KeyError:
            continue
        assert payload == ("é" * 1000).encode() and head["WARC-Type"] == "response"
        break
    else:
        raise AssertionError("record 9 is in no bundle")
    assert write_archives(pages.limit(0)).count() == 0


def brute_base(text):
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark, docs, corpus, no_docs, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)] + [(None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    for doc_id, text, *_ in corpus:
        r, base = got[doc_id], brute_base(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.kept and r.base_failed)
    assert quality_rules(no_docs, labels).count() == 0
    assert quality_rules(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_quality_tells_noise(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "of", "and", "house", "river", "said"]) for _ in range(80)) for _ in range(60)]
    noise = [" ".join(rng.choice(["buy!!", "NOW$$", "click", "###", "win"]) for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(x for pair in zip(good, noise, strict=True) for x in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = quality_rules(docs, labels).where("not base_failed").collect()
    assert out and all(r.kept == (r.doc_id % 2 == 0) for r in out)


def test_threshold_keeps_the_good():
    import numpy as np

    assert threshold_of(np.array([1.0, 2, 3]), np.array([-3.0, -2]), 0.99) == pytest.approx(-0.5)
    assert threshold_of(np.array([]), np.array([1.0]), 0.99) == -np.inf


def test_language(spark, no_docs, odd_docs):
    rng = random.Random(8)
    vocabulary = {"en": ["the", "house", "thing", "with", "water", "ring"], "de": ["der", "haus", "dinge", "wasser", "mit", "über"], "fr": ["le", "maison", "chose", "avec", "l'eau", "être"]}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=30)).capitalize(), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !?", "de"), (1002, "", None), (1003, "wasserhaus dingeren", None), (None, "the water", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:180])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {i for i in range(180) if got[i].held_out} == {i for i in range(180) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    assert language_id(no_docs).count() == 0 and language_id(odd_docs).count() == odd_docs.count()
    assert docs.where(held_out()).count() == sum(r.held_out for r in got.values())


def brute_languages(rows, evidence=20.0, least=2):
    """Plain Python over strings: rows (doc_id, text, lang) -> doc_id: (lang, score, words, known words)."""
    word = regex.compile(r"[\p{L}\p{M}]+")
    names = sorted({lang for _, t, lang in rows if t is not None and lang is not None})
    grams = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)]
    counts = {n: {lang: Counter() for lang in names} for n in range(6)}
    for i, t, lang in rows:
        if i is None or t is None or lang is None or zlib.crc32(str(i).encode()) % 5 == 0:
            continue
        for w in word.findall(t.lower()):
            for n in range(6):
                counts[n][lang].update(grams(w, n) if n else [w])
    logs = {}
    for n, by in counts.items():
        known = [g for g, c in sum(by.values(), Counter()).items() if c >= least]
        logs[n] = {g: [math.log(by[x][g] + 0.5) - math.log(by[x].total() + 0.5 * (len(known) + 1)) for x in names] for g in known}
    out = []
    for i, t, _ in rows:
        words, found = word.findall((t or "").lower()), []
        for w in words:
            hits = [logs[0][w]] if w in logs[0] else next((x for n in (5, 4, 3, 2, 1) if (x := [logs[n][g] for g in grams(w, n) if g in logs[n]])), [[0.0] * len(names)])
            found.append([sum(c) / len(hits) for c in zip(*hits, strict=True)])
        if not words or not regex.search(r"\p{L}", t):
            out.append((i, "und", 0.0))
            continue
        mean = [sum(c) / len(words) * min(len(words), evidence) for c in zip(*found, strict=True)]
        share = [math.exp(x - max(mean)) for x in mean]
        best = max(range(len(names)), key=lambda j: (share[j], -j))
        out.append((i, names[best], share[best] / sum(share)))
    return out


def test_language_equals_a_plain_scorer(spark):
    rng = random.Random(3)
    vocabulary = {"de": ["straße", "über", "haus—hof", "wasser", "ein", "im"], "el": ["σπίτι", "νερό", "και", "το", "ένα"], "en": ["house", "water", "“and”", "the", "one", "im"], "hi": ["पानी", "घर", "और", "एक"]}
    rows = [(i, " ".join(rng.choices(vocabulary[x], k=rng.randint(1, 40))), x) for i, x in enumerate(["de", "el", "en", "hi"] * 30)]
    rows += [(500 + i, "".join(rng.choices("abeinrstuwσνήपा", k=9)) + " 12 " + rng.choice(["im", "", "wasserhaus"]), None) for i in range(40)]
    rows += [(600, "im im", "de"), (601, "im im", "en"), (602, None, "de"), (603, "", "en"), (604, "1 2 ́", "en"), (605, "İm IM", None), (1, "the the", "en"), (1, "the the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = sorted((i, lang, round(score, 4)) for i, lang, score in brute_languages(rows))
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in language_id(docs).collect()) == want


def test_equal_evidence_goes_to_the_first_name(spark):
    rows = [(i, "same words here", "ba"[i % 2]) for i in range(2000) if zlib.crc32(str(i).encode()) % 5][:1000]
    rows = [r for x in "ab" for r in [y for y in rows if y[2] == x][:400]] + [(5000, "same words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 6)) for r in language_id(docs).collect()} == {("a", 0.5)}


def test_coverage_floor_counts_every_row(spark):
    """One row in 150 has little coverage, each another: only a count of all rows gives the quantile's own."""
    known, strange = " ".join(["the water"] * 15), lambda i: " ".join(["the"] + ["qzx"] * (25 + i))
    model = fit(spark.createDataFrame([(i, "the water", "en") for i in range(4)], "doc_id long, text string, lang string"))
    rows = [(i, strange(i // 150) if i % 150 == 0 else known, "en") for i in range(12_000)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = sorted(r.coverage for r in identify(held, model).collect())
    assert told[79] < 0.2 <= told[80]
    assert coverage_floor(held, model) == told[59]  # the 60th of 12,000
    assert coverage_floor(held.where("doc_id % 150 <> 0"), model) == 0.2
    assert coverage_floor(held.limit(0), model) == 0.0


def test_sample_takes_the_smallest_hashes(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "if(id < 30, 'few', if(id % 3 = 0, 'b', 'a')) as lang")
    got = {(r.doc_id, r.lang) for r in sampled(rows, 100).collect()}
    by = {}
    for r in rows.withColumn("h", F.xxhash64("doc_id")).collect():
        by.setdefault(r.lang, []).append((r.h, r.doc_id))
    assert got == {(i, lang) for lang, x in by.items() for _, i in sorted(x)[:100]}


def texts_of(spark, rows, parts=1):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return {r.page_id: r.text for r in extract(pages).collect()}


def plain_page(*blocks):
    return "".join(f"<div>{x}</div>" for x in ("Site menu", *blocks, "About us"))


def test_copies_keep_their_content(spark):
    story = [f"Paragraph {i} of a story that was copied on this host" for i in range(5)]
    near = [[*story[:k], f"Changed block {k} stands here now", *story[k + 1 :]] for k in range(5)]
    other = ["An entirely different story about rivers", "and what its second paragraph has to say of them"]
    bodies = [story, story, *near, story, other]
    got = texts_of(spark, [(i, f"http://c.x/{i}", plain_page(*b)) for i, b in enumerate(bodies)])
    assert got == {i: "\n\n".join(b) for i, b in enumerate(bodies)}
    # without a different page nothing can be told apart
    alike = texts_of(spark, [(i, f"http://c.x/{i}", plain_page(*story)) for i in range(3)])
    assert set(alike.values()) == {"\n\n".join(["Site menu", *story, "About us"])}


def test_every_page_meets_its_real_neighbours(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.x/{i:03d}", plain_page(f"Story {i} tells of {i * i} things and of {i + 7} more")) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert texts_of(spark, rows, 3) == {i: f"Story {i} tells of {i * i} things and of {i + 7} more" for i, _, _ in rows}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_marks_leave_the_article():
    text = lambda source: main_text(page_lines(source))
    for name in ("post category-social", "tag-search", "social"):
        assert text(f'<article class="{name}"><p>Text</article>') == "Text"
        assert text(f'<main id="{name}"><p>Text</main>') == "Text"
    assert text('<div class="content-with-sidebar"><p>Text</div>') == "Text"
    assert text('<div class="page-social"><article><p>Text</article></div>') == "Text"
    assert text('<article><h2 id="social-impact">Impact</h2><p id="search-strategy">Plan<section id="share-prices" class="alert-levels"><p>Prices</section></article>') == "Impact\n\nPlan\n\nPrices"
    assert text('<article><p>Text<div class="share-buttons">Share</div><div id="comments">No</div><article class="comment">Nor</article></article>') == "Text"
    assert text('<article hidden><p>No</article><div class="site-banner">No</div><div>Text</div>') == "Text"


def test_clashing_labels_count_as_the_worse(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"{'ab'[i % 2]}word{k}" for k in range(60)], k=80))) for i in range(80)], "doc_id long, text string")
    labels = [(i, 1 - i % 2, 0) for i in range(40)]
    clashing = labels + [(i, 1, 0) for i in range(1, 40, 2)] + [(i, 0, None) for i in range(1, 40, 2)]
    ddl = "doc_id long, quality int, toxic int"
    want, got = ({(r.doc_id, r.kept, r.score) for r in quality_rules(docs, spark.createDataFrame(x, ddl)).collect()} for x in (labels, clashing))
    assert got == want and len({x[1] for x in want}) == 2


def test_long_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "v", "x" * 3_000_000), (3, "w", "x" * 2_999_999)], "page_id long, url string, html string")
    write_archives(pages, path=str(tmp_path / "w"))
    assert sorted((r.page_id, r.refers_to, r.payload_bytes) for r in read_archives(spark, str(tmp_path / "w")).collect()) == [(1, None, 3_000_000), (2, 1, 3_000_000), (3, None, 2_999_999)]


def test_toxic_documents_do_not_set_the_threshold(spark):
    rng = random.Random(6)
    words = {"good": ["the", "of", "and", "house", "river", "said"], "toxic": ["hate", "idiot", "scum", "vile", "stupid", "filth"]}
    kinds = ["good", "toxic"] * 60
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words[k], k=80))) for i, k in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(k == "toxic")) for i, k in enumerate(kinds) if i < 80], "doc_id long, quality int, toxic int")
    out = quality_rules(docs, labels).where("not base_failed").collect()
    assert out and all(r.kept == (r.doc_id % 2 == 0) for r in out)


def test_bundles_are_cut_by_size(spark, tmp_path):
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, f"u{i}", rng.randbytes(2000).hex() if i % 3 else "same") for i in range(90)], "page_id long, url string, html string").repartition(2)
    folder = str(tmp_path / "w")
    written = write_archives(pages, path=folder, frame_bytes=4000, file_bytes=20_000).collect()
    # a file ends with the frame that passes the limit (here at most two records above it) and its tables
    assert len(written) > 4 and max(r.n_bytes for r in written) < 20_000 + 8_000 and sum(r.n_records for r in written) == 90
    got = read_archives(spark, folder).collect()
    assert sorted((r.page_id, bytes(r.payload).decode() if r.record_type == "response" else "same") for r in got) == sorted((r.page_id, r.html) for r in pages.collect())
    assert {r.page_id: r.refers_to for r in got if r.refers_to is not None} == dict.fromkeys(range(3, 90, 3), 0)


def test_scores_and_verdicts_equal_a_plain_version(spark, docs, corpus):
    """The score from n-grams in plain Python: one added to every bucket, mean log ratio over words and pairs; the cut by trying all."""
    import numpy as np

    from graphlode.llm.quality import _buckets
    from graphlode.llm.textvec import Words

    buckets, labels = 64, [(i, int(i % 3 != 0), int(i % 7 == 0)) for i in range(0, 60, 2)]
    texts = {r[0]: r[1] or "" for r in corpus}
    grams = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t)
        alone = {x: int(_buckets(Words([x.encode()]), buckets)[0][0]) for x in set(w)}
        pairs = {p: int(_buckets(Words([" ".join(p).encode()]), buckets)[0][2]) for p in set(zip(w, w[1:], strict=False))}
        grams[i] = [alone[x] for x in w] + [pairs[p] for p in zip(w, w[1:], strict=False)]

    def share(ids):
        n = Counter(g for i in ids for g in grams[i])
        return [math.log((n[k] + 1) / (sum(n.values()) + buckets)) for k in range(buckets)]

    trusted = {i for i, q, toxic in labels if q and not toxic}
    target, raw = share(trusted), share(texts)
    score = {i: sum(target[k] - raw[k] for k in g) / max(1, len(g)) for i, g in grams.items()}
    judged = [i for i, *_ in labels if not (brute_base(texts[i])[0] < 50 or 100 * brute_base(texts[i])[4] > 50 * brute_base(texts[i])[0])]
    good, bad = ([score[i] for i in judged if (i in trusted) == t] for t in (True, False))
    cuts = sorted({*good, *bad})
    best = max(range(len(cuts)), key=lambda k: (sum(x >= cuts[k] for x in good) / len(good) + sum(x < cuts[k] for x in bad) / len(bad), -k))
    cut = cuts[best] if best == 0 else (cuts[best] + cuts[best - 1]) / 2
    cut = min(cut, float(np.quantile(good, 0.005)))
    got = {r.doc_id: r for r in quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=buckets).collect()}
    assert len(good) > 5 and len(bad) > 5
    for i in texts:
        assert got[i].score == pytest.approx(score[i], abs=1e-9)
        if abs(score[i] - cut) > 1e-9:
            assert got[i].kept == (not got[i].base_failed and score[i] >= cut)


def test_threshold_on_tables_equals_the_plain_one(spark):
    import numpy as np

    from graphlode.llm.quality import exact_threshold

    rng = np.random.default_rng(3)
    for n, digits in ((700, 1), (400, 6), (3, 6)):
        good, bad = rng.normal(0.4, 1, n).round(digits), rng.normal(-0.4, 1, n // 2).round(digits)
        rows = spark.createDataFrame([(True, float(x)) for x in good] + [(False, float(x)) for x in bad], "trusted boolean, score double").repartition(3)
        for share in (0.995, 0.6, 0.0):
            assert exact_threshold(rows, share) == pytest.approx(threshold_of(good, bad, share), abs=1e-12)
    assert exact_threshold(rows.where("trusted"), 0.995) == -np.inf


def test_every_trusted_document_teaches(spark):
    """More than 10,000 labelled documents of a class: none is left out of the model."""
    import numpy as np

    from graphlode.llm.quality import fit as fit_quality
    from graphlode.llm.quality import gram_counts

    n = 10_500
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id, ' and w', id % 7) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    model, scored = fit_quality(docs, labels, buckets=256)
    raw = gram_counts(docs, 256)
    assert scored.count() == n and np.abs(model.log_ratio).max() < 1e-12 and raw.sum() == 5 * n


def test_differencing_reads_pages_with_an_article(spark):
    def page(i, inside, outside):
        return f"<div>Site menu of this host</div><article><p>{inside}</article><div>{outside}</div><div>About us and the host</div>"

    def story(i):
        return f"The story {i} is long and tells of {i * i} things that stand on no other page"

    teasers = [(i, f"http://t.x/{i}", page(i, f"Teaser {i}", story(i))) for i in range(4)]
    articles = [(i, f"http://a.x/{i}", page(i, f"{story(i)}<p>A quoted passage that two articles share", f"By {i}")) for i in range(10, 14)]
    # no template is known: of one page alone, and of pages that share nothing
    alone = [(20, "http://l.x/1", page(20, "Teaser", story(20)))]
    unlike = [(i, f"http://u.x/{i}", f"<div>Menu {i}</div><article><p>Short {i}</article><div>{story(i)}</div>") for i in range(30, 32)]
    got = texts_of(spark, teasers + articles + alone + unlike + teasers[:1], 3)
    want = {i: f"Teaser {i}\n\n{story(i)}" for i in range(4)} | {i: f"{story(i)}\n\nA quoted passage that two articles share" for i in range(10, 14)}
    assert got == want | {20: "Teaser", 30: "Short 30", 31: "Short 31"}
    assert extract(spark.createDataFrame(teasers + teasers[:1], "page_id long, url string, html string")).count() == 5
