"""Joins between samples, features, reads and reference tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import intervals as I
from lociframe.session import settle
from lociframe.operators.piles import near_tiles
from lociframe.operators.rangejoin import (
    flanked, overlap_pairs, pairs_within, points_in_intervals, within,
)
from lociframe.operators.tiles import TILE, cover_pieces, merge_intervals, running, tile_of, tile_window


def align_samples(df: DataFrame, samples: Sequence[str], values: Sequence[str], keys=("chrom", "chrom_pos")) -> DataFrame:
    """One row per position present in every sample, value columns as `<value>_<sample>`.

    A grouped pivot: one shuffle whatever the number of samples.
    """
    pick = [F.max(F.when(F.col("sample") == s, F.col(c))).alias(f"{c}_{s}") for s in samples for c in values]
    rows = df.filter(F.col("sample").isin(list(samples)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *pick).filter(F.col("_n") == len(samples)).drop("_n")


def within_features(df: DataFrame, features: DataFrame, feat_types: Sequence[str], flank: int = 0) -> DataFrame:
    """Positions inside at least one feature of each named type."""
    return reduce(lambda d, t: within(d, features.filter(F.col("feat_type") == t), flank=flank), feat_types, df)


def spans_meeting(spans: DataFrame, b: DataFrame, keys: Sequence[str], width: int = TILE) -> DataFrame:
    """Those distinct (keys, start_pos, end_pos) spans that share a base with `b`.

    Both sides are cut at tile borders; inside a tile the cover of `b` is disjoint, so the last
    piece starting at or before the span end decides.
    """
    keys = list(keys)
    cover = cover_pieces(b, keys, width=width).select(
        *keys, tile_of("start_pos", width).alias("_tile"), F.col("start_pos").alias("_p"), F.lit(0).alias("_k"), F.col("end_pos").alias("_far"))
    tiles = F.explode(F.sequence(tile_of("start_pos", width), tile_of("end_pos", width)))
    asks = spans.withColumn("_tile", tiles).withColumn("_p", F.least(F.col("end_pos"), ((F.col("_tile") + 1) * width - 1).cast("int")))
    rows = asks.withColumn("_k", F.lit(1)).unionByName(cover, allowMissingColumns=True)
    reach = F.max("_far").over(tile_window(keys, "_p", "_k").rowsBetween(Window.unboundedPreceding, 0))
    hit = rows.withColumn("_reach", reach).filter((F.col("_k") == 1) & (F.col("_reach") >= F.col("start_pos")))
    return hit.select(*keys, "start_pos", "end_pos").distinct()


def overlap_filter(a: DataFrame, b: DataFrame, flank: int = 0, how: str = "semi", same_strand: bool = False,
                   keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Rows of `a` that overlap (semi) or do not overlap (anti) any row of `b`."""
    keys = [*keys, "strand"] if same_strand else list(keys)
    spans = flanked(a, flank).select(*keys, "start_pos", "end_pos").distinct()
    hit = spans_meeting(spans, b.select(*keys, "start_pos", "end_pos"), keys)
    hit = flanked(hit, -flank)
    return a.join(hit, [*keys, "start_pos", "end_pos"], "left_semi" if how == "semi" else "left_anti").select(*a.columns)


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_pos: Column, right_pos: str, cols: Sequence[str],
    forward: bool = False, prefix: str = "",
) -> DataFrame:
    """Attach to each left row the last right row at or before `left_pos` (first at or after, if forward).

    `right` has one row per (keys, right_pos). Runs over distinct positions, so repeated left
    positions cost one lookup; the result comes back by an equi-join.
    """
    keys = list(keys)
    sign = -1 if forward else 1
    asks = left.select(*keys, (left_pos * sign).cast("bigint").alias("_q")).distinct()
    row = F.struct((F.col(right_pos) * sign).cast("bigint").alias("_o"), *[F.col(c) for c in cols])
    events = right.select(*keys, (F.col(right_pos) * sign).cast("bigint").alias("_q"), row.alias("_r"))
    spots = asks.withColumn("_a", F.lit(True)).unionByName(events, allowMissingColumns=True)
    spots = spots.groupBy(*keys, "_q").agg(F.max("_a").alias("_a"), F.max("_r").alias("_r"))
    found = running(spots, keys, "_q", maxes={"_hit": F.col("_r")}).filter("_a").select(*keys, "_q", "_hit")
    out = left.withColumn("_q", (left_pos * sign).cast("bigint")).join(found, [*keys, "_q"], "left")
    return out.select(*left.columns, *[F.col(f"_hit.{c}").alias(prefix + c) for c in cols])


def first_covering(features: DataFrame, keys: Sequence[str] = ("chrom",), id_col: str = "feat_id") -> DataFrame:
    """Features that reach further right than everything starting before them.

    The feature covering a point that starts first is the one of these with the smallest
    end at or after the point (equal starts: the longest counts).
    """
    keys = list(keys)
    heads = features.groupBy(*keys, "start_pos").agg(
        F.max(F.struct("end_pos", (-F.col(id_col)).alias("n"))).alias("x")
    ).select(*keys, "start_pos", F.col("x.end_pos").alias("end_pos"), (-F.col("x.n")).alias(id_col))
    seen = running(heads, keys, "start_pos", inclusive=False, maxes={"_far": F.col("end_pos")})
    return seen.filter(F.col("_far").isNull() | (F.col("end_pos") > F.col("_far"))).drop("_far")


def covering_feature(points: DataFrame, features: DataFrame, pos: str, prefix: str = "cov_") -> DataFrame:
    """Left lookup of the first-starting feature that holds each point (NULL when none)."""
    cand = first_covering(features).withColumn("_end", F.col("end_pos"))
    cols = ["start_pos", "end_pos", "feat_id"]
    out = asof(points, cand, ["chrom"], F.col(pos), "_end", cols, forward=True, prefix="_c_")
    hit = F.col("_c_start_pos") <= F.col(pos)
    return out.select(*points.columns, *[F.when(hit, F.col(f"_c_{c}")).alias(prefix + c) for c in cols])


def nearest(targets: DataFrame, features: DataFrame, max_dist: int | None = None, strand_relative: bool = True) -> DataFrame:
    """Nearest feature of each target with its signed distance; 0 on overlap.

    Ties go to the earlier start, then the longer feature, then the lower id. Three
    ordered lookups; no pairs are formed. Targets without a feature in reach get NULLs.
    """
    info = features.select("chrom", "start_pos", "end_pos", "strand", "feat_id")
    spans = settle(targets.select("chrom", "start_pos", "end_pos").distinct())
    by_end = info.groupBy("chrom", F.col("end_pos").alias("p")).agg(
        F.min(F.struct("start_pos", "feat_id", "strand", "end_pos")).alias("x")).select("chrom", "p", "x.*")
    by_start = info.groupBy("chrom", F.col("start_pos").alias("p")).agg(
        F.min(F.struct((-F.col("end_pos")).alias("o"), "feat_id", "strand", "end_pos", "start_pos")).alias("x")).select("chrom", "p", "x.*").drop("o")
    over = first_covering(info).withColumn("p", F.col("end_pos"))
    cols = ["feat_id", "start_pos", "end_pos", "strand"]
    find = lambda right, at, forward, c, prefix: asof(spans, right, ["chrom"], at, "p", c, forward, prefix)
    key = ["chrom", "start_pos", "end_pos"]
    out = find(by_end, F.col("start_pos") - 1, False, cols, "_l_")
    out = out.join(find(by_start, F.col("end_pos") + 1, True, cols, "_r_"), key)
    out = out.join(find(over, F.col("start_pos"), True, ["feat_id", "start_pos", "end_pos"], "_o_"), key)
    out = targets.join(out, key)
    left_d, right_d = F.col("start_pos") - F.col("_l_end_pos"), F.col("_r_start_pos") - F.col("end_pos")
    meets = F.coalesce(F.col("_o_start_pos") <= F.col("end_pos"), F.lit(False))
    use_left = left_d.isNotNull() & (right_d.isNull() | (left_d <= right_d))
    sign = lambda s: F.when(F.lit(strand_relative) & (F.col(s) == "-"), -1).otherwise(1)
    dist = F.when(meets, 0).when(use_left, left_d * sign("_l_strand")).otherwise(-right_d * sign("_r_strand"))
    fid = F.when(meets, F.col("_o_feat_id")).when(use_left, F.col("_l_feat_id")).otherwise(F.col("_r_feat_id"))
    out = out.select(*targets.columns, fid.alias("near_id"), dist.alias("dist"))
    if max_dist is not None:
        ok = F.abs("dist") <= max_dist
        out = out.withColumn("near_id", F.when(ok, F.col("near_id"))).withColumn("dist", F.when(ok, F.col("dist")))
    return out


def reorient(targets: DataFrame, oriented: DataFrame, flank: int = 0) -> DataFrame:
    """Strand and name taken over from overlapping oriented features when they agree.

    Features of one name and strand are merged first, so a target meets each name once per stretch.
    """
    cover = merge_intervals(oriented.select("chrom", "strand", "name", "start_pos", "end_pos"), ["chrom", "strand", "name"])
    cover = flanked(cover, flank).withColumnsRenamed(
        {"start_pos": "_s", "end_pos": "_e", "strand": "_st", "name": "_nm"})
    hits = overlap_pairs(targets.select("chrom", "feat_id", "start_pos", "end_pos"), cover, ["chrom"],
                         ("start_pos", "end_pos"), ("_s", "_e")).groupBy("feat_id").agg(
        F.bool_or(F.col("_st") == "+").alias("_fw"), F.bool_or(F.col("_st") == "-").alias("_rev"),
        F.min("_nm").alias("_n1"), F.max("_nm").alias("_n2"))
    out = targets.join(hits, "feat_id", "left")
    new = F.when(F.col("_fw") & ~F.col("_rev"), "+").when(F.col("_rev") & ~F.col("_fw"), "-").otherwise(".")
    name = F.when(F.col("_n1") == F.col("_n2"), F.col("_n1"))
    return out.withColumns({"new_strand": new, "new_name": name}).drop("_fw", "_rev", "_n1", "_n2")


# Named expression filters (percentile and t-test limits).
EXPRESSION_FILTERS = {
    "tumHigh": "pctile_tumor > 0.667",
    "tumLow": "pctile_tumor < 0.333",
    "normHigh": "pctile_normal > 0.667",
    "normLow": "pctile_tumor < 0.333",
    "tumUp": "ttest < 0.05 AND mean_tumor > mean_normal",
    "tumDown": "ttest < 0.05 AND mean_tumor < mean_normal",
}


def feature_expression(features: DataFrame, expression: DataFrame, filters: Sequence[str], id_col: str = "refseq_id") -> DataFrame:
    """Features whose gene passes each named filter, labelled `<type>_<filter>`."""
    named = F.explode(F.filter(F.array(*[F.when(F.expr(EXPRESSION_FILTERS[f]), F.lit(f)) for f in filters]), lambda x: x.isNotNull()))
    hits = expression.select(id_col, named.alias("_f")).distinct()
    return features.join(hits, id_col).withColumn("feat_type", F.concat_ws("_", "feat_type", "_f")).drop("_f")


def with_expression(features: DataFrame, expression: DataFrame, value: str, id_col: str = "refseq_id") -> DataFrame:
    """Mean expression over duplicate ids, NULL when the gene has none."""
    mean = expression.groupBy(id_col).agg(F.avg(value).alias("expression"))
    return features.join(mean, id_col, "left")


def merge_by_id(last: DataFrame, others: Sequence[DataFrame], ids: Sequence[str], rank: str) -> DataFrame:
    """Rows of `last` found in every other table; of duplicate ids there the first by `rank` counts."""
    out = last
    for t in others:
        cols = [c for c in t.columns if c not in ids and c != rank]
        first = t.groupBy(*ids).agg(F.min_by(F.struct(*cols), rank).alias("_r")).select(*ids, "_r.*")
        out = out.join(first, list(ids))
    return out


def scores_or_default(features: DataFrame, scores: DataFrame, id_col: str, score: str, default: float) -> DataFrame:
    """Left join on the upper-cased id, missing scores replaced."""
    s = scores.select(F.upper(id_col).alias("_id"), F.col(score).alias("_s"))
    out = features.join(s, F.upper(features[id_col]) == F.col("_id"), "left")
    return out.withColumn("score", F.coalesce("_s", F.lit(default))).drop("_id", "_s")


def align_to_master(master: DataFrame, table: DataFrame, id_col: str, best: str) -> DataFrame:
    """One row per master id in master order, the best of duplicates, NULLs where absent."""
    cols = [c for c in table.columns if c != id_col]
    top = table.groupBy(id_col).agg(F.max_by(F.struct(*cols), best).alias("_r")).select(id_col, "_r.*")
    return master.join(top, id_col, "left")


def merge_replicates(parts: Sequence[DataFrame], counts: Sequence[str], reference: DataFrame) -> DataFrame:
    """Summed counts over replicates; reference CpGs (plus position) missing on a strand enter with zeros."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.select("chrom", "chrom_pos", "strand", *counts) for p in parts])
    strand = F.struct(F.lit(0).alias("o"), F.lit("+").alias("s")), F.struct(F.lit(1).alias("o"), F.lit("-").alias("s"))
    zeros = reference.select("chrom", "chrom_pos", F.explode(F.array(*strand)).alias("x")).select(
        "chrom", (F.col("chrom_pos") + F.col("x.o")).alias("chrom_pos"), F.col("x.s").alias("ref_strand"),
        *[F.lit(0).cast("bigint").alias(c) for c in counts])
    both = rows.unionByName(zeros, allowMissingColumns=True)
    return both.groupBy("chrom", "chrom_pos").agg(
        F.coalesce(F.min("strand"), F.min("ref_strand")).alias("strand"), *[F.sum(c).alias(c) for c in counts],
        F.bool_or(F.col("ref_strand").isNotNull()).alias("in_reference"))


def read_pairs(calls: DataFrame, max_dist: int, mode: str = "same", cols: Sequence[str] = ("meth",)) -> DataFrame:
    """Cytosine pairs of read-level calls (read_id, chrom, strand, chrom_pos): `same`, `different` or `any` read.

    `same` joins inside a read by position bins. `different` pairs each call with one read of the
    later position: the lowest read id that is not its own, so depth does not multiply. For it the calls may come
    from bases dealt by tile with a halo of `max_dist` (`piles.tiled_bases`); then they do not move again.
    """
    if mode == "same":
        return pairs_within(calls, max_dist, ["chrom", "strand", "read_id"], "chrom_pos", cols)
    if mode == "any":
        return pairs_within(calls, max_dist, ["chrom", "strand"], "chrom_pos", ["read_id", *cols])
    row, pos = F.struct("read_id", *cols), F.col("chrom_pos")
    rows = near_tiles(calls.filter(F.col("strand").isNotNull()), "chrom_pos", 0, max_dist)
    here = Window.partitionBy("chrom", "tile", "strand", "chrom_pos").orderBy("read_id", *cols)
    ahead = Window.partitionBy("chrom", "tile", "strand").orderBy("chrom_pos").rangeBetween(1, max_dist)
    # the first row of a position stands for it, with its two lowest reads
    rows = rows.withColumns({"_r": F.row_number().over(here), "_hi": F.lead(row).over(here)})
    spot = F.when(F.col("_r") == 1, F.struct(pos.alias("pos"), row.alias("lo"), F.coalesce("_hi", row).alias("hi")))
    near = rows.withColumn("_n", F.collect_list(spot).over(ahead)).filter("home").withColumn("_n", F.explode("_n"))
    own = F.col("read_id")
    other = F.when(F.col("_n.lo.read_id") != own, F.col("_n.lo")).when(F.col("_n.hi.read_id") != own, F.col("_n.hi"))
    out = near.withColumn("_b", other).filter(F.col("_b").isNotNull())
    return out.select(
        "chrom", "strand", pos.alias("pos_1"), F.col("_n.pos").alias("pos_2"), (F.col("_n.pos") - pos).alias("dist"), own.alias("read_id_1"), F.col("_b.read_id").alias("read_id_2"),
        *[F.col(c).alias(f"{c}_1") for c in cols], *[F.col(f"_b.{c}").alias(f"{c}_2") for c in cols])


def pairs_across_boundary(df: DataFrame, features: DataFrame, max_dist: int, pos: str = "chrom_pos",
                          keys: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    """Pairs with exactly one side inside a feature; `edge_dist` runs from that feature's edge."""
    marked = covering_feature(df, features, pos)
    p = pairs_within(marked, max_dist, keys, pos, ["cov_start_pos", "cov_end_pos"])
    in1, in2 = F.col("cov_start_pos_1").isNotNull(), F.col("cov_start_pos_2").isNotNull()
    edge = F.when(in1, F.col("pos_2") - F.col("cov_end_pos_1")).otherwise(F.col("cov_start_pos_2") - F.col("pos_1"))
    return p.filter(in1 != in2).select(*keys, "pos_1", "pos_2", "dist", edge.alias("edge_dist"))


def collapse_strands(df: DataFrame, counts: Sequence[str], keys: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    """Both strands of a CpG summed on the plus position."""
    plus = F.col("chrom_pos") - F.when(F.col("strand") == "-", 1).otherwise(0)
    return df.groupBy(*keys, plus.alias("chrom_pos")).agg(*[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("n_strands"))


def compare_sets(a: DataFrame, b: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """match / mismatch / missing1 / missing2 of two alignment sets."""
    x = a.select(key, F.struct(*same).alias("_a"))
    y = b.select(key, F.struct(*same).alias("_b"))
    code = F.when(F.col("_a").isNull(), "missing1").when(F.col("_b").isNull(), "missing2").when(
        F.col("_a") == F.col("_b"), "match").otherwise("mismatch")
    return x.join(y, key, "full_outer").select(key, code.alias("code"))


def significant_blocks(blocks: DataFrame, min_cpgs: int, p_value: float, ratio: float) -> DataFrame:
    """Adds `significant`: adjusted p below the limit and a large or undefined log2 ratio."""
    import math

    limit = math.log2(ratio)
    odd = F.col("log2_ratio").isin("NA", "Inf", "-Inf")
    big = odd | (F.abs(F.col("log2_ratio").try_cast("double")) >= limit)
    return blocks.filter(F.col("n_cpg") >= min_cpgs).withColumn("significant", big & (F.col("p_adj") < p_value))


def block_overlap(normal: DataFrame, tumor: DataFrame, min_cpgs: int = 3, p_value: float = 0.01, ratio: float = 2.0) -> DataFrame:
    """Blocks keyed by (chrom, snp_pos) seen in both samples, with the class of the pair."""
    n = significant_blocks(normal, min_cpgs, p_value, ratio).select("chrom", "snp_pos", F.col("significant").alias("n_sig"))
    t = significant_blocks(tumor, min_cpgs, p_value, ratio).select("chrom", "snp_pos", F.col("significant").alias("t_sig"))
    kind = F.when(F.col("n_sig") & F.col("t_sig"), "overlap").when(F.col("n_sig"), "normal_only").when(
        F.col("t_sig"), "tumor_only").otherwise("none")
    return n.join(t, ["chrom", "snp_pos"]).select("chrom", "snp_pos", kind.alias("kind"))


def allele_counts(bases: DataFrame, max_dist: int) -> DataFrame:
    """C and T reads of each cytosine split by the base seen on the same read at positions where reads differ.

    bases: read_id, chrom, pos, strand, base, call (whether it is a cytosine call), c, t. All that a cytosine meets
    lies within `max_dist` of it, so bases dealt by tile with such a halo (`piles.tiled_bases`) do not move again:
    neither their pairs nor the counts of these pass through an exchange.
    """
    spot = Window.partitionBy("chrom", "tile", "pos")
    read = Window.partitionBy("chrom", "tile", "read_id")
    rows = near_tiles(bases.filter(F.col("read_id").isNotNull()), "pos", max_dist, max_dist)
    rows = rows.withColumn("_differ", F.min("base").over(spot) != F.max("base").over(spot))
    rows = rows.filter(F.col("_differ") | (F.col("call") & F.col("home")))
    allele = F.when(F.col("_differ"), F.struct(F.col("pos").alias("snp_pos"), "base"))
    rows = rows.withColumn("_a", F.collect_list(allele).over(read)).filter(F.col("call") & F.col("home"))
    pairs = rows.select("chrom", "tile", F.col("pos").alias("chrom_pos"), "strand", "c", "t", F.inline("_a"))
    gap = F.abs(F.col("chrom_pos") - F.col("snp_pos"))
    return pairs.filter((gap > 0) & (gap <= max_dist)).groupBy("chrom", "tile", "chrom_pos", "strand", "snp_pos", "base").agg(
        F.sum("c").alias("c_reads"), F.sum("t").alias("t_reads")).drop("tile")


def offsets_to_features(points: DataFrame, features: DataFrame, flank: int, pos: str, at: str = "center",
                        unknown_as_plus: bool = True) -> DataFrame:
    """Every (point, feature) with the point within `flank` of the alignment point; offset follows the strand."""
    f = features if unknown_as_plus else features.filter(F.col("strand").isin("+", "-"))
    ref = I.anchor(F.col("start_pos"), F.col("end_pos"), F.col("strand"), at)
    f = f.select("chrom", "feat_id", F.col("strand").alias("feat_strand"), ref.alias("ref_point"))
    f = f.withColumns({"_lo": F.col("ref_point") - flank, "_hi": F.col("ref_point") + flank})
    out = points_in_intervals(points, f, ["chrom"], pos, "_lo", "_hi", width=max(64, flank)).drop("_lo", "_hi")
    off = F.when(F.col("feat_strand") == "-", F.col("ref_point") - F.col(pos)).otherwise(F.col(pos) - F.col("ref_point"))
    return out.withColumn("offset", off)


def inverted_pairs(mates: DataFrame, n: int = 20, max_mismatches: int = 3) -> DataFrame:
    """Read names whose two mates begin alike: first `n` bases differ at most `max_mismatches` times."""
    from lociframe.functions.sequence import hamming

    first = lambda k: F.max(F.when(F.col("mate") == k, F.substring("seq", 1, n)))
    both = mates.groupBy("read_name").agg(first(1).alias("a"), first(2).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.select("read_name", hamming(F.col("a"), F.col("b")).alias("mismatches")).withColumn(
        "inverted", F.col("mismatches") <= max_mismatches)


def island_flag(points: DataFrame, islands: DataFrame, pos: str = "chrom_pos") -> DataFrame:
    """`in_island` column; disjoint islands keep it one row per point."""
    cover = cover_pieces(islands.select("chrom", "start_pos", "end_pos"), ["chrom"]).withColumnsRenamed({"start_pos": "_s", "end_pos": "_e"})
    out = points_in_intervals(points, cover, ["chrom"], pos, "_s", "_e", "left")
    return out.withColumn("in_island", F.col("_s").isNotNull()).drop("_s", "_e")




def mismatches_between(a: DataFrame, b: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Differing bases of two read sets inside a cycle range, per read present in both."""
    from lociframe.functions.sequence import hamming

    cut = lambda d, n: d.select(key, F.substring("seq", first, last - first + 1).alias(n))
    return cut(a, "_a").join(cut(b, "_b"), key).select(key, hamming(F.col("_a"), F.col("_b")).alias("mismatches"))


def cpg_pairs(cytosines: DataFrame, keys: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    """Both strands of a CpG (plus at p, minus at p + 1) side by side with depths and methylation."""
    m = F.col("c_reads") / F.nullif(F.col("c_reads") + F.col("t_reads"), F.lit(0))
    side = lambda s, off, tag: cytosines.filter(F.col("strand") == s).select(
        *keys, (F.col("chrom_pos") - off).alias("chrom_pos"), (F.col("c_reads") + F.col("t_reads")).alias(f"depth_{tag}"), m.alias(f"meth_{tag}"))
    j = side("+", 0, "fw").join(side("-", 1, "rev"), [*keys, "chrom_pos"])
    total = F.col("depth_fw") + F.col("depth_rev")
    both = F.coalesce(F.col("meth_fw") * F.col("depth_fw"), F.lit(0.0)) + F.coalesce(F.col("meth_rev") * F.col("depth_rev"), F.lit(0.0))
    return j.withColumns({"depth": total, "meth": both / F.nullif(total, F.lit(0)), "strand_diff": F.abs(F.col("meth_fw") - F.col("meth_rev")),
                          "min_depth": F.least("depth_fw", "depth_rev")})
