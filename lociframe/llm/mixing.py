"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its share of the target text divided by the text it has. The
number of copies of a document is the inverse of the Poisson distribution with that mean at a
uniform number made of a seeded hash of the document's id: no state, the same on every attempt.
Means over PART are the sum of equal parts, each with a hash of its own, so the table of the
distribution stays short at any rate. Every document is exploded by its count and the copies are
sorted by another seeded hash, which is a global shuffle that a lost task repeats exactly.

Sizes are aggregated for the named sources and all others together, so what reaches the driver is
bounded by the number of given weights, and no join on the source (which may hold a third of all
rows) takes place.

Defined results: null and unknown sources belong to the rest; weights of sources without text are
spread over the others in proportion, and documents of a source without any text keep rate 1; null
and empty texts take part like others; rows with equal ids get equal counts, a null id is replaced
by its text's digest; an input column named like the copy number is replaced; empty tables give
empty results.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import fresh, table

PART = 32.0
#: production weights: shares of the text; the rest goes to all other sources together
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.08, "src4": 0.02}
SEED = "mix-1"


def distribution(mean: float) -> list[float]:
    """Poisson distribution function at 0, 1, ... until it no longer grows."""
    term = total = math.exp(-mean)
    out, k = [total], 0
    while k < mean or term > 1e-18:
        k += 1
        term *= mean / k
        total += term
        out.append(total)
    return out


def uniform(*parts: Column) -> Column:
    """52 bits of a hash of the parts as a number from 0 below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(mean: float, seed: str, ident: Column) -> Column:
    """Poisson count with the given mean, by the hash of ident."""
    parts = max(1, math.ceil(mean / PART))
    table_ = F.array(*[F.lit(x) for x in distribution(mean / parts)])

    def one(j: Column) -> Column:
        u = uniform(F.lit(seed), j.cast("string"), ident)
        return F.aggregate(table_, F.lit(0), lambda n, x: n + (x <= u).cast("int"))

    if parts == 1:
        return one(F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), lambda n, j: n + one(j))


def rates(docs: DataFrame, weights: Mapping[str, float], text_col: str = "text", source_col: str = "source", target: float | None = None) -> dict[str | None, float]:
    """Mean repetition rate of each named source and, under None, of the rest.

    target: characters wanted in all; by default as many as there are. One row per given weight
    reaches the driver.
    """
    rest = 1 - sum(weights.values())
    if rest < -1e-9 or min(weights.values(), default=0) < 0:
        raise ValueError("weights must not be negative or exceed 1 together")
    wanted = {**weights, None: max(rest, 0.0)}
    named = F.when(F.col(source_col).isin(list(weights)), F.col(source_col))
    sizes = {r["s"]: r["n"] or 0 for r in docs.groupBy(named.alias("s")).agg(F.sum(F.length(text_col)).alias("n")).collect()}
    total = sum(w for s, w in wanted.items() if sizes.get(s))
    target = float(sum(sizes.values())) if target is None else float(target)
    return {s: w / total * target / sizes[s] if sizes.get(s) and total else 1.0 for s, w in wanted.items()}


def mix(docs: DataFrame, weights: Mapping[str, float], seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target: float | None = None, copy_col: str | None = None) -> DataFrame:
    """The rows repeated by their counts in a seeded random order; `copy_col` names a copy number."""
    found = rates(docs, weights, text_col, source_col, target)
    kept = [c for c in docs.columns if c.lower() != (copy_col or "").lower()]
    # a clashing input column, in whatever case, is not among the kept ones
    number = copy_col or fresh(docs, "copy_number")[0]
    (key,) = fresh(docs.withColumn(number, F.lit(0)), "shuffle_key")
    ident = F.coalesce(F.col(id_col).cast("string"), F.md5(text_col))
    count = copies(found[None], seed, ident)
    for source in weights:
        count = F.when(F.col(source_col) == source, copies(found[source], seed, ident)).otherwise(count)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias(number))
    ident = F.coalesce(F.col(id_col).cast("string"), F.md5(text_col))
    rows = rows.withColumn(key, F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col(number).cast("string"), ident))).orderBy(key).drop(key)
    return rows if copy_col else rows.drop(number)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, WEIGHTS, copy_col="copy").select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "text")


_NAMED = " ".join(f"WHEN '{s}' THEN {w!r}" for s, w in WEIGHTS.items())
_LIST = ", ".join(f"'{s}'" for s in WEIGHTS)
ORACLE_SQL = {"op7_mixing": f"""
WITH RECURSIVE b AS (SELECT doc_id, source, text, CASE WHEN source IN ({_LIST}) THEN source END AS s FROM documents),
z AS (SELECT s, sum(length(text)) AS n, CAST(CASE s {_NAMED} ELSE {1 - sum(WEIGHTS.values())!r} END AS DOUBLE) AS w FROM b GROUP BY s),
r AS MATERIALIZED (SELECT s, CASE WHEN n > 0 THEN w / (SELECT sum(w) FROM z WHERE n > 0) * (SELECT sum(n) FROM z) / n ELSE 1.0::DOUBLE END AS rate FROM z),
parts AS MATERIALIZED (SELECT s, greatest(1, ceil(rate / 32))::INT AS parts, rate / greatest(1, ceil(rate / 32)) AS mean FROM r),
p AS (SELECT s, 0 AS k, exp(-mean) AS term, exp(-mean) AS cdf, mean FROM parts
      UNION ALL SELECT s, k + 1, term * (mean / (k + 1)), cdf + term * (mean / (k + 1)), mean FROM p WHERE k < mean OR term > 1e-18),
cdf AS MATERIALIZED (SELECT s, list(cdf ORDER BY k) AS cdf FROM p GROUP BY s),
u AS (SELECT doc_id, b.s AS s, source, text, ('0x' || substr(md5('{SEED}|' || j || '|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
      FROM b JOIN parts ON parts.s IS NOT DISTINCT FROM b.s, LATERAL (SELECT unnest(range(parts.parts)) AS j)),
c AS (SELECT doc_id, any_value(source) AS source, any_value(text) AS text, sum(len(list_filter(cdf, lambda x: x <= u)))::BIGINT AS n
      FROM u JOIN cdf ON cdf.s IS NOT DISTINCT FROM u.s GROUP BY doc_id)
SELECT doc_id, source, unnest(range(1, n + 1)) AS copy, text FROM c"""}

QUERIES = {"op7_mixing": op7_mixing}
