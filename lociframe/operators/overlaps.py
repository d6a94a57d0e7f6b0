"""Overlaps of many feature types at once, from counts of open features along the chromosome.

Nothing here forms pairs of features: the number of tuples that share a base, the shared bases and
the nearest feature of each type all follow from running sums and maxima with one slot per type.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.operators.tiles import running


def choices(feat_types: Sequence[str], most: int = 4, master: str | None = None) -> list[tuple[str, ...]]:
    """Combinations of two to `most` types in the given order, or the pairs with a master type."""
    if master is not None:
        return [(master, t) for t in feat_types if t != master]
    return [c for n in range(2, most + 1) for c in combinations(feat_types, n)]


def open_counts(features: DataFrame, feat_types: Sequence[str]) -> DataFrame:
    """chrom, p and, for type i: `s{i}` and `e{i}`, features that begin at p or end before it, and `n{i}`, those open at p."""
    ends = F.explode(F.array(F.struct(F.col("start_pos").cast("bigint").alias("p"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                             F.struct((F.col("end_pos").cast("bigint") + 1).alias("p"), F.lit(0).alias("s"), F.lit(1).alias("e"))))
    marks = features.filter(F.col("feat_type").isin(list(feat_types))).select("chrom", "feat_type", ends.alias("m"))
    tally = lambda t, side: F.sum(F.when(F.col("feat_type") == t, F.col(f"m.{side}")).otherwise(0))
    spots = marks.groupBy("chrom", F.col("m.p").alias("p")).agg(*[tally(t, side).alias(f"{side}{i}") for i, t in enumerate(feat_types) for side in "se"])
    return running(spots, ["chrom"], "p", sums={f"n{i}": F.col(f"s{i}") - F.col(f"e{i}") for i in range(len(feat_types))})


def combination_counts(features: DataFrame, feat_types: Sequence[str], most: int = 4, master: str | None = None) -> DataFrame:
    """One row per combination of types (`types`, in order): n tuples of features, one of each type, that share a base, and the shared `bases`.

    Intervals that meet pairwise share a point, and the first one is where the last of them begins:
    a tuple is counted there, as the tuples that are open after the beginnings at p less those open
    before. Bases are the places where all are open, as sums over the places where that changes.
    """
    chosen = choices(feat_types, most, master)
    slot = {t: i for i, t in enumerate(dict.fromkeys([*feat_types, *(t for c in chosen for t in c)]))}
    runs = open_counts(features, list(slot))
    number = lambda c: c.cast("decimal(9,0)")
    product = lambda cs: reduce(lambda x, y: x * y, map(number, cs)).cast("decimal(38,0)")
    every = lambda cs: F.when(reduce(lambda x, y: x & y, [c > 0 for c in cs]), 1).otherwise(0)
    columns: list[Column] = []
    for k, combo in enumerate(chosen):
        now = [F.col(f"n{slot[t]}") for t in combo]
        rest = [F.col(f"n{slot[t]}") - F.col(f"s{slot[t]}") for t in combo]
        ahead = [F.col(f"n{slot[t]}") - F.col(f"s{slot[t]}") + F.col(f"e{slot[t]}") for t in combo]
        columns += [F.sum(product(now) - product(rest)).alias(f"t{k}"), F.sum(F.col("p") * (every(ahead) - every(now))).alias(f"b{k}")]
    if not columns:
        return features.sparkSession.createDataFrame([], "types array<string>, n decimal(38,0), bases bigint")
    one = runs.agg(*columns)
    rows = [F.struct(F.array(*map(F.lit, combo)).alias("types"), F.coalesce(f"t{k}", F.lit(0)).cast("decimal(38,0)").alias("n"), F.coalesce(f"b{k}", F.lit(0)).cast("bigint").alias("bases")) for k, combo in enumerate(chosen)]
    return one.select(F.inline(F.array(*rows)))


def overlap_shares(features: DataFrame, feat_types: Sequence[str], most: int = 4, master: str | None = None) -> DataFrame:
    """`combination_counts` against each of its types: share of the type's features, remainder and its share.

    Tuples are counted, so a share is above 1, and a remainder negative, where features meet several others.
    """
    singles = features.groupBy("feat_type").agg(F.count(F.lit(1)).alias("n_single"))
    rows = combination_counts(features, feat_types, most, master).select("types", "n", "bases", F.explode("types").alias("feat_type"))
    share = F.col("n").cast("double") / F.col("n_single")
    return rows.join(singles, "feat_type").select(
        F.array_join("types", ",").alias("types"), "feat_type", "n_single", "n", "bases", share.alias("share"), (F.col("n_single") - F.col("n")).alias("remainder"), (1 - share).alias("remainder_share"))




def _strand_rank(strand: str = "strand") -> Column:
    return F.when(F.col(strand) == "+", 0).when(F.col(strand) == "-", 1).otherwise(2)


def nearest_by_type(targets: DataFrame, features: DataFrame, feat_types: Sequence[str], key: str = "feat_id") -> DataFrame:
    """`key`, chrom, start_pos, end_pos of every target and `d0`, `d1`, ... per type: the signed distance of its nearest feature.

    0 where one overlaps; else bases to the nearer neighbour (left before right, + before - before
    unknown among equals), negative where the target lies upstream of it, null without any feature
    on the chromosome. One forward and one backward pass carry a slot for each type.
    """
    each = range(len(feat_types))
    mine = features.filter(F.col("feat_type").isin(list(feat_types)))
    of = lambda t, c: F.when(F.col("feat_type") == t, c)
    spans = targets.select(key, "chrom", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"))
    start, end = F.col("start_pos").cast("bigint"), F.col("end_pos").cast("bigint")

    begins = mine.groupBy("chrom", start.alias("p")).agg(*[F.count(of(t, 1)).alias(f"s{i}") for i, t in enumerate(feat_types)])
    closes = mine.groupBy("chrom", end.alias("p")).agg(
        *[F.count(of(t, 1)).alias(f"e{i}") for i, t in enumerate(feat_types)], *[F.max(of(t, F.struct(end.alias("at"), (-_strand_rank()).alias("r")))).alias(f"l{i}") for i, t in enumerate(feat_types)])
    asks = spans.select("chrom", key, F.explode(F.array(F.struct((F.col("start_pos") - 1).alias("p"), F.lit("lo").alias("ask")), F.struct(F.col("end_pos").alias("p"), F.lit("hi").alias("ask")))).alias("a")).select("chrom", key, "a.*")
    rows = begins.unionByName(closes, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
    ahead = running(rows, ["chrom"], "p", peers=True, sums={f"S{i}": F.col(f"s{i}") for i in each} | {f"E{i}": F.col(f"e{i}") for i in each}, maxes={f"L{i}": F.col(f"l{i}") for i in each})

    back = mine.groupBy("chrom", (-start).alias("p")).agg(*[F.max(of(t, F.struct((-start).alias("at"), (-_strand_rank()).alias("r")))).alias(f"r{i}") for i, t in enumerate(feat_types)])
    behind = back.unionByName(spans.select("chrom", key, (-F.col("end_pos") - 1).alias("p"), F.lit("right").alias("ask")), allowMissingColumns=True)
    behind = running(behind, ["chrom"], "p", peers=True, maxes={f"R{i}": F.col(f"r{i}") for i in each})

    # the three answers of a target meet under its key
    answers = ahead.filter(F.col("ask").isNotNull()).select(key, "ask", *[f"{k}{i}" for i in each for k in "SEL"]).unionByName(
        behind.filter(F.col("ask").isNotNull()).select(key, "ask", *[f"R{i}" for i in each]), allowMissingColumns=True)
    answers = answers.unionByName(spans.select(key, F.lit("self").alias("ask"), "chrom", "start_pos", "end_pos"), allowMissingColumns=True)
    pick = lambda ask, c: F.max(F.when(F.col("ask") == ask, F.col(c)))
    met = answers.groupBy(key).agg(
        *[pick("self", c).alias(c) for c in ("chrom", "start_pos", "end_pos")],
        *[(F.coalesce(pick("hi", f"S{i}"), F.lit(0)) - F.coalesce(pick("lo", f"E{i}"), F.lit(0))).alias(f"o{i}") for i in each],
        *[pick("lo", f"L{i}").alias(f"l{i}") for i in each], *[pick("right", f"R{i}").alias(f"r{i}") for i in each])

    def distance(i: int) -> Column:
        left, right = F.col("start_pos") - F.col(f"l{i}.at"), -F.col(f"r{i}.at") - F.col("end_pos")
        signed_left = F.when(F.col(f"l{i}.r") == -1, -left).otherwise(left)
        signed_right = F.when(F.col(f"r{i}.r") == 0, -right).otherwise(right)
        nearer = F.when(left.isNotNull() & (right.isNull() | (left <= right)), signed_left).otherwise(signed_right)
        return F.when(F.col(f"o{i}") > 0, F.lit(0).cast("bigint")).otherwise(nearer)

    return met.select(key, "chrom", "start_pos", "end_pos", *[distance(i).alias(f"d{i}") for i in each])


def feature_columns(targets: DataFrame, features: DataFrame, feat_types: Sequence[str], flank: int = 0, key: str = "feat_id") -> DataFrame:
    """Targets against feature types, and a row of totals (null key).

    Column `d{i}` is 1 or 0 for an overlap if `flank` is 0, else the signed distance of the nearest
    feature within `flank`, or null; `none` is 1 where no type has one. The totals count the targets
    that have one. `key` must be unique among the targets.
    """
    each = range(len(feat_types))
    near = nearest_by_type(targets, features, feat_types, key)
    near = near.withColumns({f"d{i}": F.when(F.abs(f"d{i}") <= flank, F.col(f"d{i}")) for i in each})
    none = F.when(reduce(lambda x, y: x & y, [F.col(f"d{i}").isNull() for i in each]), 1).otherwise(0).cast("bigint")
    near = near.withColumn("none", none).withColumn("_row", F.struct(key, "chrom", "start_pos", "end_pos"))
    total = F.grouping("_row") == 1
    shown = lambda i: F.max(F.col(f"d{i}").isNotNull().cast("bigint")) if flank == 0 else F.max(f"d{i}")
    out = near.rollup("_row").agg(
        *[F.when(total, F.count(f"d{i}")).otherwise(shown(i)).alias(f"d{i}") for i in each], F.when(total, F.sum("none")).otherwise(F.max("none")).alias("none"))
    return out.select("_row.*", *[f"d{i}" for i in each], F.coalesce("none", F.lit(0)).alias("none"))
