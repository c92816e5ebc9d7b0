"""A corpus pipeline of five stages: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage works on all rows its predecessor kept; all but the last return the columns of ``documents``.

Nulls, empty and blank texts: the quality stage rejects them, so later stages do not see any; each stage alone handles them as
its operator's docstring says. Rows without an id stay. Extra columns of any name come back with their own values.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeworks.llm import bpe, mixing, neardup, pii, quality
from hazeworks.llm.common import materialize, set_aside

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    safe, restored = set_aside(docs, quality.COLUMNS)
    return restored(quality.keep_documents(safe))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of smallest id stays. Null ids stay."""
    safe, restored = set_aside(docs, [])
    rated = neardup.near_duplicates(safe, neardup.Settings(width=5, threshold=80))
    gone = rated.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return restored(safe.join(gone, "doc_id", "left_anti"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are replaced by their kind; n_chars stays the length of the source document."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as their source's rate says and come in global shuffle order."""
    safe, restored = set_aside(docs, mixing.ADDED)
    return restored(mixing.mix(safe, temperature=0.7, seed=17))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: Near-duplicates and tokens can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
