"""Values lined up on features, nucleosome scores, depleted regions, read lanes."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import intervals as I
from lociframe.operators.aggregates import FRACTION, chi_square_log10_p
from lociframe.operators.joins import offsets_to_features
from lociframe.operators.rangejoin import interval_sums
from lociframe.operators.tiles import islands, merge_intervals, position_halo, tile_window
from lociframe.session import settle


def aligned_average(points: DataFrame, features: DataFrame, flank: int, pos: str, value: Column, by: Sequence[str] = (),
                    at: str = "center") -> DataFrame:
    """Per column -flank..flank: sums and counts on the feature's own and opposite strand.

    Before anything meets, values collapse per (position, strand) and features per (anchor,
    strand) with their multiplicity, so copies of a locus on either side cost one row.
    """
    v = value
    spots = points.groupBy(*by, "chrom", pos, "strand").agg(F.sum(v.cast(FRACTION)).alias("_s"), F.count(v).alias("_n"))
    anchors = features.select("chrom", F.when(F.col("strand") == "-", "-").otherwise("+").alias("strand"),
                              I.anchor(F.col("start_pos"), F.col("end_pos"), F.col("strand"), at).alias("a"))
    anchors = anchors.groupBy("chrom", "a", "strand").agg(F.count(F.lit(1)).alias("_w"))
    # the multiplicity travels in the id column of the point-to-feature join
    spans = anchors.select("chrom", F.col("a").alias("start_pos"), F.col("a").alias("end_pos"), "strand", F.col("_w").alias("feat_id"))
    j = offsets_to_features(spots, spans, flank, pos)
    same, w = F.col("strand") == F.col("feat_strand"), F.col("feat_id")
    s = lambda c, k: F.sum(F.when(c, F.col(k).cast("double") * w))
    return j.groupBy(*by, F.col("offset").cast("int").alias("offset")).agg(
        s(same, "_s").alias("own_sum"), s(same, "_n").cast("bigint").alias("own_n"),
        s(~same, "_s").alias("other_sum"), s(~same, "_n").cast("bigint").alias("other_n"))


def aligned_matrix(points: DataFrame, features: DataFrame, flank: int, pos: str, value: Column, columns: int | None = None,
                   at: str = "center", by: Sequence[str] = ()) -> DataFrame:
    """Long matrix (feature, column): sums and counts on the feature's own and opposite strand.

    `columns` scales the 2*flank+1 offsets down to that many columns.
    """
    spots = points.groupBy(*by, "chrom", pos, "strand").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    j = offsets_to_features(spots, features, flank, pos, at)
    rel = F.col("offset") + flank
    col = rel if columns is None else F.floor(rel * (columns / (2 * flank + 1)) + 0.5)
    limit = (2 * flank + 1) if columns is None else columns
    same = F.col("strand") == F.when(F.col("feat_strand") == "-", "-").otherwise("+")
    out = j.withColumn("col", col.cast("int")).filter((F.col("col") >= 0) & (F.col("col") < limit))
    s = lambda c, k: F.sum(F.when(c, F.col(k)))
    return out.groupBy(*by, "feat_id", "col").agg(
        s(same, "_s").alias("own_sum"), s(same, "_n").alias("own_n"), s(~same, "_s").alias("other_sum"), s(~same, "_n").alias("other_n"))


def zero_out(matrix: DataFrame, ranges: DataFrame, tiny: float = 0.0001) -> DataFrame:
    """Columns lo <= col < hi of a feature set to zero sums with a tiny count (feat_id, lo, hi)."""
    r = ranges.groupBy("feat_id").agg(F.collect_list(F.struct("lo", "hi")).alias("_r"))
    hit = F.exists(F.col("_r"), lambda x: (F.col("col") >= x["lo"]) & (F.col("col") < x["hi"]))
    hit = F.coalesce(hit, F.lit(False))
    j = matrix.join(r, "feat_id", "left").withColumn("_h", hit)
    sums = {c: F.when(F.col("_h"), 0.0).otherwise(F.col(c).cast("double")) for c in ("own_sum", "other_sum")}
    counts = {c: F.when(F.col("_h"), tiny).otherwise(F.col(c).cast("double")) for c in ("own_n", "other_n")}
    return j.withColumns({**sums, **counts}).drop("_r", "_h")


def row_scores(matrix: DataFrame, n_columns: int, exponent: float = 0.0, min_dist: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Sort value of each row: mean over its filled cells, weighted by distance from the middle column
    (|col - middle|, at least min_dist) to a power relative to min_dist."""
    cell = (F.coalesce("own_sum", F.lit(0.0)) + F.coalesce("other_sum", F.lit(0.0))) / F.nullif(
        F.when(F.col("own_n").isNotNull(), 1).otherwise(0) + F.when(F.col("other_n").isNotNull(), 1).otherwise(0), F.lit(0))
    middle = math.floor(n_columns / 2 + 0.5)
    dist = F.greatest(F.abs(F.col("col") - middle), F.lit(min_dist)).cast("double")
    weight = F.pow(dist, F.lit(exponent)) / (float(min_dist) ** exponent) if exponent else F.lit(1.0)
    return matrix.groupBy(*by, "feat_id").agg((F.sum(cell * weight) / F.count(cell)).alias("sort_value"))


def downscale(matrix: DataFrame, row: str, rows: tuple[int, int] | None, cols: tuple[int, int], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of cells whose indices fall together when (from, to) sizes shrink; real division."""
    shrink = lambda c, fr, to: F.floor(F.col(c) * (to / fr)).cast("int")
    r = shrink(row, *rows).alias(row) if rows else F.col(row)
    return matrix.groupBy(*by, r, shrink("col", *cols).alias("col")).agg(F.avg(value).alias(value))


def phase_bins(points: DataFrame, features: DataFrame, flank: int, width: int, pos: str, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean and count per feature and strand-aware bin of the aligned range (whole bins only)."""
    j = offsets_to_features(points.withColumn("_v", value).filter(F.col("_v").isNotNull()), features, flank, pos)
    b = F.floor((F.col("offset") + flank) / width).cast("int")
    whole = (2 * flank) // width
    return j.filter(b < whole).groupBy(*by, "feat_id", b.alias("bin")).agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))


def nucleosome_score(centres: DataFrame, reads: DataFrame, cycle: int = 73, half: int = 20, period: int = 185, pseudo: float = 0.005,
                     metric: str = "ratio", phased_factor: int = 2) -> DataFrame:
    """Phased (plus reads one half nucleosome before, minus reads after) against unphased reads.

    centres: chrom, centre. metric: ratio (log2, per base with pseudocount), diff, min_diff.
    """
    shifts = [0, -period, period] if metric == "ratio" else [0]
    n = lambda strand: F.count(F.when(F.col("strand") == strand, 1))
    starts = reads.select("chrom", F.col("start_pos").cast("bigint").alias("centre"), "strand", F.lit(False).alias("_c"))
    spots = starts.unionByName(centres.select("chrom", F.col("centre").cast("bigint").alias("centre"), F.lit(None).cast("string").alias("strand"), F.lit(True).alias("_c")))
    spots = spots.groupBy("chrom", "centre").agg(n("+").alias("_fw"), n("-").alias("_rev"), F.max("_c").alias("_c"))
    # all windows lie at fixed distances, so one halo of the tile serves them as range frames
    reach = max(cycle, *map(abs, shifts)) + half
    rows = position_halo(spots, "centre", reach, reach)
    w = tile_window(["chrom"], "centre")
    within = lambda value, shift: F.coalesce(F.sum(value).over(w.rangeBetween(shift - half, shift + half)), F.lit(0))
    both = F.col("_fw") + F.col("_rev")
    g = rows.withColumns({"pre": within("_fw", -cycle), "post": within("_rev", cycle), "unphased": sum(within(both, sh) for sh in shifts)})
    kind = centres.schema["centre"].dataType
    g = g.filter(F.col("_home") & F.col("_c")).select("chrom", F.col("centre").cast(kind).alias("centre"), *[F.col(c).cast("bigint").alias(c) for c in ("pre", "post", "unphased")])
    phased = F.col("pre") + F.col("post")
    p_len, u_len = phased_factor * half, 2 * half * len(shifts)
    if metric == "ratio":
        score = F.log2((phased + pseudo * p_len) / (F.col("unphased") + pseudo * u_len) * (u_len / p_len))
    elif metric == "diff":
        score = (phased - F.col("unphased")).cast("double")
    else:
        score = (F.least("pre", "post") - F.col("unphased")).cast("double")
    return g.withColumn("score", score)


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def rank_sum_p(mid: Column, adj: Column) -> Column:
    """One-sided rank sum p that the values of array `mid` are larger, normal with ties and continuity corrected.

    1 where all values are equal; null where an array is empty or null.
    """
    def score(v: Column) -> Column:
        m, a, both = v["m"], v["a"], v["both"]
        n1, n2 = F.size(m), F.size(a)
        n = (n1 + n2).cast("double")
        u = F.aggregate(m, F.lit(0.0), lambda acc, x: acc + _count(a, lambda y: y < x) + 0.5 * _count(a, lambda y: y == x))
        ties = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + F.pow(_count(both, lambda y: y == x).cast("double"), F.lit(2.0)) - 1) / (n * (n - 1))
        var = n1 * n2 / 12.0 * (n + 1 - ties)
        return F.struct(u.alias("u"), (n1 * n2 / 2.0 + 0.5).alias("mean"), var.alias("var"))

    def p(x: Column) -> Column:
        tail = 0.5 * F.pow(F.lit(10.0), chi_square_log10_p(x["chi"]))
        return F.when(x["chi"].isNull(), 1.0).when(x["up"], tail).otherwise(1 - tail)

    # each step reads the one before it as a value, through an array of one
    one = F.transform(F.array(F.struct(mid.alias("m"), adj.alias("a"), F.concat(mid, adj).alias("both"))), score)
    one = F.transform(one, lambda x: F.struct((F.pow(x["u"] - x["mean"], F.lit(2.0)) / F.when(x["var"] > 1e-9, x["var"])).alias("chi"), (x["u"] >= x["mean"]).alias("up")))
    return F.when((F.size(mid) > 0) & (F.size(adj) > 0), F.get(F.transform(one, p), F.lit(0)))


def ks_p(mid: Column, adj: Column) -> Column:
    """One-sided two-sample Smirnov p that the values of array `mid` are larger (asymptotic); null where an array is empty or null.

    One walk over the values of both arrays in order, for the rows of a batch at once: a value of `adj` lifts the difference
    of the two shares, one of `mid` lowers it, in units of 1 / (n1 * n2). Of equal values those of `mid` come first, so no
    top lies inside a tie.
    """
    @F.arrow_udf("double")
    def p(mid: pa.Array, adj: pa.Array) -> pa.Array:
        n1, n2 = (pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (mid, adj))
        m, a = mid.flatten(), adj.flatten()  # without those of missing rows
        row = np.concatenate([np.repeat(np.arange(len(n1)), n1), np.repeat(np.arange(len(n2)), n2)])
        by = np.concatenate([-np.repeat(n2, n1), np.repeat(n1, n2)])
        missing = np.concatenate([pc.is_null(side).to_numpy(zero_copy_only=False) for side in (m, a)])
        value = np.concatenate([pc.fill_null(side, 0.0).to_numpy(zero_copy_only=False) for side in (m, a)])
        by[missing] = 0
        order = np.lexsort((by, value, row))
        at = np.concatenate([[0], np.cumsum(by[order])])
        begin = np.concatenate([[0], np.cumsum(n1 + n2)])
        # the first place of a row is that before its values, where the difference is none
        top = np.zeros(len(n1), np.int64)
        some = n1 + n2 > 0
        if some.any():
            top[some] = np.maximum.reduceat(at[1:], begin[:-1][some])
        top = np.maximum(top - at[begin[:-1]], 0)
        ok = (n1 > 0) & (n2 > 0)
        size = np.where(ok, n1 * n2, 1).astype(float)
        d = top / size
        return pa.array(np.exp(-2.0 * d * d * size / np.where(ok, n1 + n2, 1)), mask=~ok)

    return p(mid.cast("array<double>"), adj.cast("array<double>"))


def depletion_windows(sites: DataFrame, window: int = 147, linker: int = 30, min_depth: int = 1, keys: Sequence[str] = ("chrom",),
                      pos: str = "chrom_pos") -> DataFrame:
    """For a window ending at each site: values in the window and in the linkers before and after it.

    sites: keys, pos, c, t. Lists are bounded by the window lengths since positions are unique.
    """
    d = sites.filter(F.col("c") + F.col("t") >= max(1, min_depth)).withColumn("_m", F.col("c") / (F.col("c") + F.col("t")))
    rows = position_halo(d.select(*keys, pos, "_m"), pos, window + linker, linker)
    w = tile_window(keys, pos)
    take = lambda a, b: F.collect_list("_m").over(w.rangeBetween(a, b))
    return rows.select(*keys, F.col(pos).alias("end_pos"), "_home", take(-(window - 1), 0).alias("mid"),
                       take(-(window + linker - 1), -window).alias("pre"), take(1, linker).alias("post")).filter("_home").drop("_home")


def depleted_regions(sites: DataFrame, window: int = 147, linker: int = 30, min_sites: int = 5, min_sites_linker: int = 3, min_depth: int = 1,
                     threshold: float = 0.4, diff: float = 0.4, test: str | None = None, alpha: float = 0.01, keys: Sequence[str] = ("chrom",),
                     pos: str = "chrom_pos") -> DataFrame:
    """Windows of high accessibility merged to regions.

    Without a test: window mean >= threshold and above a linker mean by `diff`. With `rank` or
    `ks`: the window values are significantly larger than those of a linker.
    """
    w = depletion_windows(sites, window, linker, min_depth, keys, pos)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(c), F.lit(0))
    w = w.filter(F.size("mid") >= min_sites)
    usable = {s: F.size(s) >= min_sites_linker for s in ("pre", "post")}
    if test:
        fn = {"rank": rank_sum_p, "ks": ks_p}[test]
        ok = [usable[s] & (F.coalesce(F.when(usable[s], fn(F.col("mid"), F.col(s))), F.lit(1.0)) < alpha) for s in usable]
    else:
        ok = [usable[s] & (mean("mid") >= threshold) & (mean("mid") - mean(s) >= diff) for s in usable]
    good = w.filter(ok[0] | ok[1]).select(*keys, (F.col("end_pos") - window + 1).alias("start_pos"), "end_pos")
    return merge_intervals(good, list(keys))


def read_lanes(reads: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Lowest free lane for each read of a pile, reads taken by start (then end, id).

    A lane depends on the reads before it, so each pile of overlapping reads is walked in order;
    rows stream through sorted and the state is one end coordinate per open lane.
    """
    keys = list(keys)
    lab = islands(reads.select(*keys, "read_id", "start_pos", "end_pos"), keys, "start_pos", "end_pos")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pile, busy, free, used = None, [], [], 0
        for pdf in batches:
            lanes = []
            for key, s, e in zip(pdf[[*keys, "island"]].itertuples(index=False, name=None), pdf["start_pos"], pdf["end_pos"]):
                if key != pile:
                    pile, busy, free, used = key, [], [], 0
                while busy and busy[0][0] < s:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    lane = heapq.heappop(free)
                else:
                    lane, used = used, used + 1
                heapq.heappush(busy, (e, lane))
                lanes.append(lane)
            yield pdf.assign(lane=lanes)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lab.schema.fields) + ", lane int"
    ordered = lab.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "start_pos", "end_pos", "read_id")
    return ordered.mapInPandas(walk, schema).drop("island")


def read_tiers(reads: DataFrame, bounds: Sequence[float], value: str = "meth", keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Lanes per tier of methylation: tier i holds the reads with bounds[i] < value <= bounds[i + 1].

    Adds tier, lane (lowest free one within the tier) and level, the lane counted over all tiers of
    the keys from the lowest. Reads outside the bounds, or without a value, are left out; bounds may be
    infinite.
    """
    keys = list(keys)
    tier = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        tier = F.when((F.col(value) > low) & (F.col(value) <= high), i).otherwise(tier)
    rows = reads.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    lanes = settle(read_lanes(rows, [*keys, "tier"]))
    used = lanes.groupBy(*keys, "tier").agg((F.max("lane") + 1).alias("_n"))  # a row per tier
    below = used.select(*keys, "tier", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    return lanes.join(below, [*keys, "tier"]).withColumn("level", (F.col("lane") + F.col("_below")).cast("int")).drop("_below")


def motif_density(motifs: DataFrame, regions: DataFrame, pos: str = "chrom_pos") -> DataFrame:
    """Motifs per 100 bases inside each region (regions: id, chrom, start_pos, end_pos, ...)."""
    s = interval_sums(motifs, regions, {"n": F.lit(1)}, pos)
    return s.withColumn("density", 100.0 * F.col("n") / (F.col("end_pos") - F.col("start_pos") + 1))
