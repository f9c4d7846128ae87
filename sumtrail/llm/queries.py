"""One query per corpus operator, over its whole table, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumtrail.llm import (
    bpe, hamming_search, hard_negatives, heap_clusters, html_wrapper, language, line_dedup, line_quality, mixing,
    ngram_join, pii, quality_lm, url_filter,
)
from sumtrail.llm.common import table
from sumtrail.llm.oracle import ORACLE  # noqa: F401


def op1_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that labels call good and not toxic."""
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality_lm.classified(table(spark, sf_dir, "documents"), labels)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).drop("url")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, corpus_pipeline.vocabulary(), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every row whose id is divisible by 20, among all rows."""
    rows = table(spark, sf_dir, "embeddings")
    codes = rows.where(F.size("embedding") == 64).select(
        F.col("vec_id").alias("id"), hamming_search.sign_code(F.col("embedding"), 64).alias("code"))
    found = hamming_search.neighbours(codes, codes.where(F.col("id") % 20 == 0), k=10, bits=64)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"),
                        F.col("distance").cast("long").alias("distance"))


def op5_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.texts(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.reported(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0))
    model = language.fit(docs.where(fold != 0).select("text", "lang"))
    return language.identified(docs, model).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.measured(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return line_dedup.report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100, candidates all rows; every seventh label is moved by one."""
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        hard_negatives.whole(F.col("embedding"), 256).alias("vector"))
    return hard_negatives.mined(rows, rows.where("id % 100 = 0"))


def op13_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), hard_negatives.whole(F.col("embedding"), 1024).alias("vector"))
    return heap_clusters.report(rows).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_quality_lm": op1_quality_lm,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_hamming_search": op4_hamming_search,
    "op5_html_wrapper": op5_html_wrapper,
    "op6_pii": op6_pii,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_line_quality": op9_line_quality,
    "op10_ngram_join": op10_ngram_join,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_heap_clusters": op13_heap_clusters,
    "pipeline": corpus_pipeline.run,
}
