"""The operators' registered queries, over the whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bpe import bpe_round_trip
from .common import read
from .divergence import divergence
from .exact_dedup import exact_duplicates
from .html_text import extract
from .language import language_id
from .line_dedup import dedup_lines
from .merkle import audit, document_leaves, manifest
from .ngram_join import near_duplicates
from .packing import pack_documents
from .pii import as_text, find_pii
from .quality import quality_rules
from .sstable import read_shards, write_shards
from .warc import read_archives, write_archives


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)
    folder = manifest.select("folder").head()
    if folder is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder[0], manifest)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=5, percent=80)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_archives(read(spark, sf_dir, "pages"))
    folder = written.select("folder").head()
    if folder is None:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder[0], with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = document_leaves(read(spark, sf_dir, "documents"), modulus=7)
    return audit(manifest(leaves, by=["doc_id"]), "doc_id", "claim")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"), min_docs=3, top=200)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_token_shards, op2_exact_dedup, op3_bpe, op4_ngram_join, op5_line_dedup, op6_html_text, op7_warc, op8_packing, op9_quality, op10_language_id, op11_merkle, op12_pii, op13_divergence, pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
