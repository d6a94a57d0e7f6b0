"""Training text from raw documents: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from lociframe.llm import bpe, linedup, minhash, mixing, quality
from lociframe.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the trees learn from the labelled rows of this stage's own input."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; the documents stay."""
    return linedup.remove(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights; the rows come in a seeded random order."""
    return mixing.mix(docs, mixing.WEIGHTS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every remaining row."""
    return bpe.digests(docs, bpe.default_ranks())


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe),
]

#: SQL can express neither the trees nor the merges; tests/llm holds run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. Intermediate tables go to the folder in spark.checkpoint.dir."""
    from lociframe.session import checkpoint_root

    folder = os.path.join(checkpoint_root(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
