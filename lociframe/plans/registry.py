"""Registry of runnable questions: key, Spark function and, where SQL can say it, oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe import fixtures
from lociframe.operators.piles import tiled_bases
from lociframe.operators.rangejoin import parts_of

# Shares of small counts often end exactly on half a unit of the last compared digit, where the
# last bit of a floating sum decides. Both engines add this before rounding.
NUDGE = 1e-9

# Text from which the reads of one task come; its bases are some times as many.
PART_BYTES = 4 << 20


def near(value: Column, digits: int = 6) -> Column:
    """Rounding for comparison."""
    return F.round(value.cast("double") + NUDGE, digits)


def near_double(value: Column, digits: int) -> Column:
    """`near` for doubles well below 10^(15 - digits), by the nearest whole unit instead of decimal numbers."""
    unit = F.lit(10.0**digits)
    return F.rint((value + NUDGE) * unit) / unit + F.lit(0.0)


@dataclass(frozen=True)
class Question:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


QUESTIONS: dict[str, Question] = {}


class Views:
    """Fixture views and plain tables by attribute, e.g. `v.cytosine`, `v.orders`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if "v_" + name in fixtures.VIEWS:
            return fixtures.view(self.spark, self.sf_dir, "v_" + name)
        if name in fixtures.TABLES:
            return fixtures.table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def tiled_bases(self, halo: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
        """The rows of `base`, dealt by tile; the number of tasks follows the length of the texts."""
        size = self.documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(self.spark.sparkContext.defaultParallelism, -(-size // part_bytes))
        return tiled_bases(self.alignment, halo, parts)

    def dealt_cytosine(self) -> DataFrame:
        """The rows of `cytosine`, summed in tasks whose number follows that of the lineitem rows."""
        rows = self.lineitem
        parts = parts_of(self.spark, rows.count())
        dealt = rows.repartition(parts, F.expr("CAST(l_partkey * 10 + l_linenumber AS INT)"))
        return self.spark.sql(fixtures.VIEWS["v_cytosine"].format(**fixtures.SPARK, lineitem="{lineitem}"), lineitem=dealt)


def question(key: str, views: str = "", sql: str | None = None):
    """Register `fn(v: Views) -> DataFrame` under `key` with its oracle."""

    def add(fn):
        if key in QUESTIONS:
            raise ValueError(f"duplicate key {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        text = sql.replace("ROUND(", "ROUND(1e-9 + ") if sql else None
        QUESTIONS[key] = Question(run, fixtures.oracle(views, text) if text else None)
        return fn

    return add
