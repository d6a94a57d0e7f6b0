"""Range joins as equi-joins on (keys, bin).

An interval is copied to the bins it touches, a point has one bin, and the exact predicate
stays as a residual filter. Membership tests (`within`) first reduce the intervals to a
disjoint union, so a point meets at most a handful of intervals whatever the overlap depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators.tiles import cover_pieces, running, running_at
from lociframe.session import settle

BIN = 256

# Rows that one task of an ordered pass sorts.
PART_ROWS = 1 << 18


def parts_of(spark: SparkSession, rows: int) -> int:
    """Partitions that grow with the rows. Spark's own joining of small partitions goes by compressed size, and
    rows that are mostly empty are tens of times as large when they are sorted or grouped."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width).cast("bigint"), F.floor(end / width).cast("bigint"))


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    pos: str,
    start: str = "start_pos",
    end: str = "end_pos",
    how: str = "inner",
    width: int = BIN,
) -> DataFrame:
    """Join points with the intervals that hold them; `how` is inner, left_semi or left.

    Non-key column names of the two sides must differ.
    """
    a = points.withColumn("_bin", F.floor(F.col(pos) / width).cast("bigint"))
    b = intervals.withColumn("_bin", F.explode(bins(F.col(start), F.col(end), width)))
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_b"), *[c for c in intervals.columns if c not in keys])
    on = (F.col("_bin") == F.col("_b")) & F.col(pos).between(F.col(start), F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    out = a.join(b, on, how)
    return out.drop("_bin", "_b", *[f"_k_{k}" for k in keys])


def flanked(features: DataFrame, flank: int, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    return features.withColumn(start, F.col(start) - flank).withColumn(end, F.col(end) + flank)


def within(
    points: DataFrame,
    features: DataFrame,
    pos: str = "chrom_pos",
    keys: Sequence[str] = ("chrom",),
    flank: int = 0,
    how: str = "left_semi",
    width: int = BIN,
) -> DataFrame:
    """Points inside (left_semi) or outside (left_anti) any feature widened by `flank`."""
    cover = cover_pieces(flanked(features, flank).select(*keys, "start_pos", "end_pos"), list(keys))
    cover = cover.withColumnsRenamed({"start_pos": "_start", "end_pos": "_end"})
    return points_in_intervals(points, cover, list(keys), pos, "_start", "_end", how, width)


def within_each_type(
    points: DataFrame,
    features: DataFrame,
    pos: str = "chrom_pos",
    flank: int = 0,
    feat_type: str = "feat_type",
    width: int = BIN,
) -> DataFrame:
    """One row per (point, feature type that holds it); a point counts once per type."""
    cover = cover_pieces(
        flanked(features, flank).select("chrom", feat_type, "start_pos", "end_pos"), ["chrom", feat_type]
    ).withColumnsRenamed({"start_pos": "_start", "end_pos": "_end"})
    return points_in_intervals(points, cover, ["chrom"], pos, "_start", "_end", "inner", width).drop("_start", "_end")


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int = BIN,
) -> DataFrame:
    """All overlapping pairs of two interval sets (column names must differ apart from keys).

    A pair that shares several bins is kept only in the first shared one.
    """
    (ls, le), (rs, re) = left_span, right_span
    a = left.withColumn("_bin", F.explode(bins(F.col(ls), F.col(le), width)))
    b = right.withColumn("_bin", F.explode(bins(F.col(rs), F.col(re), width)))
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width)
    hit = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.col("_bin") == first)
    return a.join(b, [*keys, "_bin"]).filter(hit).drop("_bin")


def overlap_count(
    targets: DataFrame,
    features: DataFrame,
    keys: Sequence[str] = ("chrom",),
    start: str = "start_pos",
    end: str = "end_pos",
    flank: int = 0,
    name: str = "n_overlaps",
) -> DataFrame:
    """Number of features meeting each target, without forming the pairs.

    #starts <= target end minus #ends < target start, both read from running counts
    over distinct positions.
    """
    keys = list(keys)
    lo, hi = F.col(start) - flank, F.col(end) + flank
    marks = features.select(*keys, F.explode(F.array(
        F.struct(F.col("start_pos").alias("p"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct((F.col("end_pos") + 1).alias("p"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("m"))
    asks = targets.select(*keys, F.explode(F.array(lo, hi)).alias("p")).distinct()
    spots = (
        marks.select(*keys, "m.p", "m.s", "m.e")
        .unionByName(asks.select(*keys, "p", F.lit(0).alias("s"), F.lit(0).alias("e")))
        .groupBy(*keys, "p").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    )
    run = running(spots, keys, "p", sums={"ns": F.col("s"), "ne": F.col("e")})
    run = settle(run.join(asks, [*keys, "p"], "left_semi").select(*keys, "p", "ns", "ne"))
    at_end = run.select(*keys, F.col("p").alias("_hi"), F.col("ns").alias("_ns"))
    at_start = run.select(*keys, F.col("p").alias("_lo"), F.col("ne").alias("_ne"))
    out = targets.withColumn("_lo", lo).withColumn("_hi", hi)
    out = out.join(at_end, [*keys, "_hi"]).join(at_start, [*keys, "_lo"])
    return out.withColumn(name, F.col("_ns") - F.col("_ne")).select(*targets.columns, name)


def interval_sums(
    points: DataFrame,
    intervals: DataFrame,
    values: dict[str, Column],
    pos: str,
    keys: Sequence[str] = ("chrom",),
    start: str = "start_pos",
    end: str = "end_pos",
    per: str | None = None,
    per_values: Sequence | None = None,
) -> DataFrame:
    """Sums of point values inside each interval as differences of running sums.

    Work grows with points + intervals, never with their pairs. Fractional values are
    taken as DECIMAL so that differences are exact. `per`/`per_values` (for instance the
    samples) give one row per interval and value; intervals without points give zeros.
    """
    keys = list(keys)
    grp = [*keys, *([per] if per else [])]
    parts = parts_of(points.sparkSession, points.count() + 2 * len(per_values or [0]) * intervals.count())
    asks = intervals.select(*keys, F.explode(F.array(F.col(start) - 1, F.col(end))).alias("_p"))
    asks = asks.repartition(parts, *keys, "_p").distinct()
    spans = intervals
    if per:
        each = F.explode(F.array(*[F.lit(v) for v in per_values]))
        asks = asks.withColumn(per, each)
        spans = intervals.withColumn(per, each)
    data = points.groupBy(*grp, F.col(pos).alias("_p")).agg(*[F.sum(c).alias(n) for n, c in values.items()])
    spots = data.withColumn("_ask", F.lit(False)).unionByName(asks.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    run = running_at(spots, grp, "_p", "_ask", {n: F.col(n) for n in values}, parts)

    def at(end_name: str, letter: str) -> DataFrame:
        side = run.select(*grp, F.col("_p").alias(end_name), *[F.col(n).alias(f"_{letter}_{n}") for n in values])
        return side.repartition(parts, *grp, end_name).hint("merge")

    out = spans.withColumn("_hi", F.col(end)).withColumn("_lo", F.col(start) - 1)
    # intervals made by an explode are far larger than Spark's estimate: never gathered for a broadcast
    out = out.repartition(parts, *grp, "_hi").join(at("_hi", "h"), [*grp, "_hi"])
    out = out.repartition(parts, *grp, "_lo").join(at("_lo", "l"), [*grp, "_lo"])
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"_h_{n}"), F.lit(0)) - F.coalesce(F.col(f"_l_{n}"), F.lit(0)))
    return out.select(*spans.columns, *values)


def pairs_within(
    df: DataFrame,
    max_dist: int,
    keys: Sequence[str],
    pos: str,
    cols: Sequence[str] = (),
    min_dist: int = 1,
) -> DataFrame:
    """Ordered pairs (a before b) of one table at distance min_dist..max_dist.

    Bins are as wide as the distance: b looks in its own bin and the one before it.
    Output: keys, `pos_1`, `pos_2`, `dist`, and every column of `cols` with _1 / _2.
    """
    keys = list(keys)
    base = F.floor(F.col(pos) / max_dist).cast("bigint")
    a = df.select(*keys, F.explode(F.array(base, base + 1)).alias("_bin"),
                  F.col(pos).alias("pos_1"), *[F.col(c).alias(f"{c}_1") for c in cols])
    b = df.select(*keys, base.alias("_bin"), F.col(pos).alias("pos_2"), *[F.col(c).alias(f"{c}_2") for c in cols])
    gap = F.col("pos_2") - F.col("pos_1")
    return (
        a.join(b, [*keys, "_bin"]).filter(gap.between(min_dist, max_dist))
        .withColumn("dist", gap).drop("_bin")
    )
