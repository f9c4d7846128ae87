"""From raw documents to an encoded training mix, in five stages.

Each stage works on all that the one before kept and is written before the next
reads it. All but the last return the columns of documents.

1. quality: rejected documents and bad lines go.
2. near duplicates: one document of each group of linked documents stays.
3. personal data: spans are redacted in the text.
4. mix: each document as often as its source's target asks for.
5. encode: every text as tokens, with the decoded text.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sumtrail.llm import bpe, line_quality, mixing, ngram_join, pii
from sumtrail.session import written


def vocabulary() -> str:
    """The vocabulary file; TOKENIZERS_DIR names another folder."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs.select("doc_id", "lang", "source", "text"), vocabulary()).select(
        "doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("bpe", encode),
]

#: The stages train a model and merge tokens, which SQL can't; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
