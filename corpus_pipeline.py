"""Preparing the corpus: each stage's decisions take effect before the next one runs.

All stages but the last return the columns of `documents`. A null or empty text fails the
quality rules and goes in the first stage. Line deduplication may leave a text empty; the
document goes on, and of several empty ones near deduplication keeps one. The mix may take
a document more than once, as the rows of several epochs; the last stage encodes every row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.llm import bpe, line_dedup, mixing, near_duplicates, quality_rules
from ledgerwright.llm.queries import MIX, RANKS
from ledgerwright.llm.shipping import ship
from ledgerwright.llm.texts import table
from ledgerwright.session import scratch_path

# Not expressible in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current quality policy."""
    return quality_rules.accepted(docs)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand elsewhere; `n_chars` follows the text."""
    cleaned = line_dedup.cleaned(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", length).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their domain, language and source."""
    return mixing.mixed(docs, **MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document: `doc_id, n_tokens, ids`."""
    return bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", clean_lines),
    ("near_duplicates", one_of_each),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again by the next."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
