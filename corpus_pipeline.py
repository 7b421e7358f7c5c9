"""From raw documents to packed sequences: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame. `run` writes each result as
Parquet to the shared folder and reads it again for the next stage. All stages but the last return the columns
of documents. A filtering stage keeps a row unless its operator rejects it. Rows with a null id, and rows that share an id with others, are
judged by their own text alone, in groups of near duplicates after all rows with an id of their own (lines: rows that share an id are one
document there, and each row without an id is a document after all others). An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.llm.common import read, shared_dir, staged
from graphlode.llm.language import MIN_WORDS, UNDETERMINED, coverage_floor, fit, held_out, identify
from graphlode.llm.line_dedup import dedup_lines
from graphlode.llm.ngram_join import near_duplicates
from graphlode.llm.packing import pack_documents
from graphlode.llm.quality import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CAPACITY, END_ID, TOKENIZER = 1024, 2, "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the likelihood ratio."""
    judged = quality_rules(docs, read(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.where("kept").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: those with a letter that are short or hold enough words of the model.

    The floor of that coverage is checked on labelled held-out rows. If no row teaches, all documents with a letter stay.
    """
    known = docs.select("doc_id", "text", "lang")
    model = fit(known.where(~held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    floor = coverage_floor(known.where(held_out()), model)
    judged = identify(docs, model, keep=COLUMNS)
    covered = (F.col("n_words") < MIN_WORDS) | (F.col("coverage") >= floor)
    return judged.where((F.col("lang_pred") != UNDETERMINED) & covered).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; n_chars follows the text."""
    cut = dedup_lines(docs, keep=tuple(c for c in COLUMNS if c not in ("text", "n_chars")))
    return cut.select("row.*", F.col("kept_text").alias("text"), F.length("kept_text").cast("long").alias("n_chars")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    keyed = with_keys(docs)
    gone = near_duplicates(keyed, id_col="key").where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(gone.hint("merge"), "key", "left_anti").select(*COLUMNS)


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with a key for each row, in the order of ids: the id where one row alone has it; rows without id, or that share one, get numbers above all ids (without room for these, ids are moved down)."""
    named = docs.withColumn("key", F.col("doc_id").cast("long"))
    repeated = staged(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    nameless = docs.where("doc_id is null")
    if repeated.isEmpty() and nameless.isEmpty():
        return named
    without = nameless.unionByName(docs.join(repeated.hint("merge"), "doc_id", "left_semi").select(*docs.columns))
    numbered = staged(without.withColumn("at", F.monotonically_increasing_id()), "without-id")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).head()
    last = numbered.agg(F.max("at")).head()[0]
    least, most = (0, -1) if most is None else (least, most)
    down = max(0, most + 1 + last - (2**63 - 1))
    if least - down < -(2**63):
        raise ValueError("the ids leave no room for rows without one")
    own = named.where("doc_id is not null").join(repeated.hint("merge"), "doc_id", "left_anti")
    moved = own.select(*docs.columns, (F.col("key") - F.lit(down)).alias("key"))
    return moved.unionByName(numbered.withColumn("key", F.col("at") + F.lit(most - down + 1)).drop("at"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids."""
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY, with_ids=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES = [("quality", quality), ("language", language), ("line_dedup", lines), ("near_duplicates", near_copies), ("packing", packing)]

#: The likelihood ratio, the language model and the packing plan have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
