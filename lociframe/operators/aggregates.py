"""Grouped summaries over positions, features and samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import methylation as M
from lociframe.operators.piles import place
from lociframe.operators.rangejoin import interval_sums, pairs_within, points_in_intervals, within_each_type
from lociframe.operators.tiles import row_halo, running, tile_window

# sums of fractions as exact decimals: the same whatever the order of the rows
FRACTION = "decimal(38,18)"


def summary_columns(value: Column, weight: Column | None = None, prefix: str = "") -> list[Column]:
    """n, sum, mean, weighted mean (weights <= 0 ignored), population stdev, min, max."""
    out = [
        F.count(value).alias(prefix + "n"), F.sum(value).alias(prefix + "sum"), F.avg(value).alias(prefix + "mean"),
        F.stddev_pop(value).alias(prefix + "stdev"), F.min(value).alias(prefix + "min"), F.max(value).alias(prefix + "max"),
    ]
    if weight is not None:
        w = F.when((weight > 0) & value.isNotNull(), weight)
        out.append((F.sum(value * w) / F.nullif(F.sum(w), F.lit(0))).alias(prefix + "weighted_mean"))
    return out


def summarize(df: DataFrame, by: Sequence[str], value: Column, weight: Column | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*summary_columns(value, weight))


def methylation_by_feature(cytosines: DataFrame, features: DataFrame, flank: int = 0) -> DataFrame:
    """Mean methylation of mutation-filtered cytosines per sample and feature type.

    A cytosine counts once per type; features of a type are merged first, so a position meets
    one interval per type and the aggregation combines map-side.
    """
    rows = within_each_type(cytosines.filter(M.not_mutated()).withColumn("_m", M.frac_meth()), features, flank=flank)
    one = lambda s: F.avg(F.when(F.col("strand") == s, F.col("_m")))
    return rows.groupBy("sample", "feat_type").agg(
        F.count(F.lit(1)).alias("n_cytosines"), F.avg("_m").alias("mean_meth"),
        one("+").alias("mean_meth_fw"), one("-").alias("mean_meth_rev"))


def qc_by_feature(cytosines: DataFrame, features: DataFrame) -> DataFrame:
    """Coverage, deamination percent, nonconversion percent and density per sample and feature type."""
    rows = within_each_type(cytosines, features)
    nonconv = 100.0 * F.col("c_reads_nonconv") / F.nullif(M.ct_reads(False), F.lit(0))
    seen = M.not_mutated() & (F.col("total_reads_opp") >= 5)
    size = features.groupBy("feat_type").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("bases"))
    out = rows.groupBy("sample", "feat_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(M.total_reads()).alias("coverage"),
        F.avg(F.when(M.not_mutated(), 0.0).otherwise(100.0)).alias("deamination_pct"),
        F.avg(F.when(seen, nonconv)).alias("nonconversion_pct"))
    return out.join(size, "feat_type").withColumn("density", F.col("n") / F.col("bases")).drop("bases")


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int, by: Sequence[str] = (), normalized: bool = False) -> DataFrame:
    """Counts per bin; outer bins are open, a value equal to a bin end stays in the lower bin."""
    width = (hi - lo) / bins
    idx = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((value - lo) / width) - 1)).cast("int")
    out = df.filter(value.isNotNull()).groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if not normalized:
        return out
    if not by:
        return out.withColumn("share", F.col("n") / out.agg(F.sum("n")).scalar())
    total = out.groupBy(*by).agg(F.sum("n").alias("_t"))
    return out.join(total, list(by)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def neighbour_spans(features: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Previous and next distinct span of each feature (order start, end) as prev_/next_ columns."""
    keys = list(keys)
    spans = features.select(*keys, "start_pos", "end_pos").distinct()
    halo = row_halo(spans, keys, "start_pos", 1, 1, ["start_pos", "end_pos"])
    w = tile_window(keys, "start_pos", "end_pos")
    near = halo.select(
        *keys, "start_pos", "end_pos", "_home",
        F.lag("start_pos").over(w).alias("prev_start"), F.lag("end_pos").over(w).alias("prev_end"),
        F.lead("start_pos").over(w).alias("next_start"), F.lead("end_pos").over(w).alias("next_end"),
    ).filter("_home").drop("_home")
    return features.join(near, [*keys, "start_pos", "end_pos"])


def shores(features: DataFrame, near: int, far: int, three_prime: bool = False) -> DataFrame:
    """Flank `near`..`far` outside one end of each feature; dropped when it meets a neighbour.

    Sets `shore_start`, `shore_end`. The right side is taken for minus features (plus when
    three_prime); all others use the left side.
    """
    f = neighbour_spans(features)
    right = F.col("strand") == ("+" if three_prime else "-")
    lo = F.when(right, F.col("end_pos") + near).otherwise(F.col("start_pos") - far)
    hi = F.when(right, F.col("end_pos") + far).otherwise(F.col("start_pos") - near)
    f = f.withColumns({"shore_start": lo, "shore_end": hi})
    hits = lambda p: F.coalesce((F.col("shore_start") <= F.col(f"{p}_end")) & (F.col(f"{p}_start") <= F.col("shore_end")), F.lit(False))
    return f.filter(~hits("prev") & ~hits("next")).select(*features.columns, "shore_start", "shore_end")


def feature_statistics(cytosines: DataFrame, spans: DataFrame, samples: Sequence[str], start: str, end: str) -> DataFrame:
    """Per (span, sample): number of cytosines, mean methylation, mean C+T coverage."""
    meth = M.frac_meth().cast(FRACTION)
    sums = interval_sums(
        cytosines, spans, {"n": F.lit(1), "_m": meth, "_nm": meth.isNotNull().cast("bigint"), "_r": M.ct_reads(True)},
        "chrom_pos", start=start, end=end, per="sample", per_values=samples)
    return sums.select(
        *spans.columns, "sample", F.col("n").cast("bigint").alias("n"),
        (F.col("_m").cast("double") / F.nullif(F.col("_nm"), F.lit(0))).alias("mean_meth"),
        (F.col("_r").cast("double") / F.nullif(F.col("n"), F.lit(0))).alias("mean_reads"))


def window_methylation(cytosines: DataFrame, features: DataFrame, sizes: Sequence[int], samples: Sequence[str],
                       side: str = "both", min_meth_outside: float = 0.0) -> DataFrame:
    """Mean methylation around each feature at several window sizes, as columns `w<size>`.

    side: both, five, three. Size 0 is the feature itself; larger windows skip cytosines below
    `min_meth_outside` (nonconverted reads included).
    """
    s, e, strand = F.col("start_pos"), F.col("end_pos"), F.col("strand")
    out = None
    for size in sizes:
        lo, hi = s, e
        if size and side == "both":
            half = size / 2.0
            lo, hi = F.floor(s - half + 0.5).cast("int"), F.floor(e + half + 0.5).cast("int")
        elif size:
            upstream = strand == ("+" if side == "five" else "-")
            known = strand.isin("+", "-")
            lo = F.when(known & upstream, s - size).when(known, e).otherwise(s)
            hi = F.when(known & upstream, s).when(known, e + size).otherwise(e)
        spans = features.select("feat_id", "chrom", F.lit(size).alias("size"), lo.alias("w_start"), hi.alias("w_end"))
        out = spans if out is None else out.unionByName(spans)
    keep = F.coalesce(M.frac_meth(False) >= min_meth_outside, F.lit(True))
    meth = M.frac_meth().cast(FRACTION)
    vals = {"_a": meth, "_an": meth.isNotNull().cast("bigint"),
            "_b": F.when(keep, meth), "_bn": (keep & meth.isNotNull()).cast("bigint")}
    sums = interval_sums(cytosines, out, vals, "chrom_pos", start="w_start", end="w_end", per="sample", per_values=samples)
    total = F.when(F.col("size") == 0, F.col("_a")).otherwise(F.col("_b")).cast("double")
    count = F.when(F.col("size") == 0, F.col("_an")).otherwise(F.col("_bn"))
    mean = sums.withColumn("mean", total / F.nullif(count, F.lit(0)))
    return mean.groupBy("feat_id", "chrom", "sample").agg(
        *[F.max(F.when(F.col("size") == z, F.col("mean"))).alias(f"w{z}") for z in sizes])


def coverage_histogram(cytosines: DataFrame, features: DataFrame, feat_types: Sequence[str]) -> DataFrame:
    """Positions per sample and coverage, one column per feature type and one for all positions."""
    cov = cytosines.withColumn("coverage", M.ct_reads())
    inside = within_each_type(cov, features.filter(F.col("feat_type").isin(list(feat_types))))
    rows = cov.select("sample", "coverage", F.lit(None).cast("string").alias("feat_type")).unionByName(
        inside.select("sample", "coverage", "feat_type"))
    cell = rows.groupBy("sample", "coverage", "feat_type").count()
    pick = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("bigint")
    return cell.groupBy("sample", "coverage").agg(
        pick(F.col("feat_type").isNull()).alias("all_positions"), *[pick(F.col("feat_type") == t).alias(t) for t in feat_types])


def depth_counts(bases: DataFrame) -> DataFrame:
    """How many positions have each depth, negative depths for the minus strand."""
    d = bases.groupBy(*place(bases, "strand")).agg(F.count(F.lit(1)).alias("n"))
    signed = F.when(F.col("strand") == "-", -F.col("n")).otherwise(F.col("n"))
    return d.groupBy(signed.alias("depth")).agg(F.count(F.lit(1)).alias("n_positions"))


def composite(df: DataFrame, counts: Sequence[str], keys: Sequence[str] = ("chrom", "chrom_pos", "strand")) -> DataFrame:
    """Counts of all samples summed per position."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), *[F.sum(c).alias(c) for c in counts])


def cytosine_stats(df: DataFrame, max_opp_a: float = 0.2, max_next_non_g: float = 0.1) -> DataFrame:
    """Totals per category: non-cytosine, CG, CH, uncertain (rows without reads left out)."""
    share_g = F.col("next_base_g") / F.nullif(F.col("next_base_total"), F.lit(0))
    no = F.lit(False)
    cat = (
        F.when(F.coalesce(M.opp_a_of_sum() > max_opp_a, no) | F.coalesce(M.frac_c_or_t() < 1 - max_opp_a, no), "noncyt")
        .when(F.coalesce(share_g >= 1 - max_next_non_g, no), "CG")
        .when(F.coalesce(share_g < max_next_non_g, no), "CH").otherwise("uncertain"))
    total, both = M.total_reads(), M.total_reads() + F.col("total_reads_opp")
    n_if = lambda c: F.sum(c.cast("bigint"))
    return df.filter(total > 0).groupBy("sample", cat.alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(total - F.col("c_reads_nonconv")).alias("reads_ss"),
        F.sum(both - F.col("c_reads_nonconv")).alias("reads_ds"),
        n_if(total >= 5).alias("ge5_ss"), n_if(total >= 10).alias("ge10_ss"), n_if(both >= 5).alias("ge5_ds"), n_if(both >= 10).alias("ge10_ds"),
        F.avg(M.frac_meth()).alias("mean_meth"), F.sum(M.ct_reads()).alias("ct_reads"), F.sum("c_reads").alias("c_reads"))


def conversion_by_coverage(df: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """C-count x coverage matrix in long form."""
    return df.groupBy(*by, M.ct_reads().alias("coverage"), F.col("c_reads")).agg(F.count(F.lit(1)).alias("n"))


def methylation_deciles(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per floor(10 m)/10, missing values as their own NULL class."""
    return df.groupBy(*by, (F.floor(M.frac_meth() * 10) / 10).alias("decile")).agg(F.count(F.lit(1)).alias("n"))


def depth_windows(reads: DataFrame, sizes: DataFrame, width: int, strands: Sequence[str] | None = None, pos: str = "start_pos") -> DataFrame:
    """Reads per fixed window; windows without reads are kept with zero."""
    by = ["chrom", "window"] + (["strand"] if strands else [])
    counts = reads.groupBy("chrom", (F.floor(F.col(pos) / width) * width).cast("bigint").alias("window"), *(["strand"] if strands else [])).agg(
        F.count(F.lit(1)).alias("n"))
    last = F.floor(F.col("length") / width).cast("bigint")
    grid = sizes.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("w")).select(
        "chrom", (F.col("w") * width).alias("window"))
    if strands:
        grid = grid.withColumn("strand", F.explode(F.array(*map(F.lit, strands))))
    return grid.join(counts, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def feature_sizes(features: DataFrame) -> DataFrame:
    return features.groupBy("feat_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("end_pos") - F.col("start_pos") + 1).cast("bigint")).alias("bases"))


def type_segments(features: DataFrame, feat_types: Sequence[str]) -> DataFrame:
    """Boundary sweep: maximal stretches with a constant set of covering types (bit mask)."""
    delta = F.explode(F.array(F.struct(F.col("start_pos").cast("bigint").alias("p"), F.lit(1).alias("d")),
                              F.struct((F.col("end_pos") + 1).cast("bigint").alias("p"), F.lit(-1).alias("d"))))
    marks = features.select("chrom", "feat_type", delta.alias("m"))
    spots = marks.groupBy("chrom", F.col("m.p").alias("p")).agg(
        *[F.sum(F.when(F.col("feat_type") == t, F.col("m.d")).otherwise(0)).alias(f"_d{i}") for i, t in enumerate(feat_types)])
    run = running(spots, ["chrom"], "p", sums={f"_n{i}": F.col(f"_d{i}") for i in range(len(feat_types))})
    mask = sum(F.when(F.col(f"_n{i}") > 0, 1 << i).otherwise(0) for i in range(len(feat_types)))
    run = run.select("chrom", "p", mask.alias("mask"))
    halo = row_halo(run, ["chrom"], "p", after=1)
    nxt = F.lead("p").over(tile_window(["chrom"], "p"))
    return halo.withColumn("seg_end", nxt - 1).filter(F.col("_home") & F.col("seg_end").isNotNull() & (F.col("mask") > 0)).select(
        "chrom", F.col("p").alias("seg_start"), "seg_end", "mask")


def shared_bases(features: DataFrame, feat_types: Sequence[str]) -> DataFrame:
    """Bases covered by exactly each combination of types."""
    return type_segments(features, feat_types).groupBy("mask").agg(F.sum(F.col("seg_end") - F.col("seg_start") + 1).alias("bases"))


def cytosine_venn(cytosines: DataFrame, features: DataFrame, feat_types: Sequence[str]) -> DataFrame:
    """Cytosines per sample and exact combination of types that hold them (0 = none).

    Boundaries of features and cytosines run through one sweep, so every cytosine reads the types
    that are open at its place; nothing is joined but one carry row per tile.
    """
    each = range(len(feat_types))
    delta = F.explode(F.array(F.struct(F.col("start_pos").cast("bigint").alias("p"), F.lit(1).alias("d")),
                              F.struct((F.col("end_pos").cast("bigint") + 1).alias("p"), F.lit(-1).alias("d"))))
    marks = features.filter(F.col("feat_type").isin(list(feat_types))).select("chrom", "feat_type", delta.alias("m"))
    marks = marks.groupBy("chrom", F.col("m.p").alias("p")).agg(*[F.sum(F.when(F.col("feat_type") == t, F.col("m.d")).otherwise(0)).alias(f"_d{i}") for i, t in enumerate(feat_types)])
    spots = cytosines.groupBy("chrom", F.col("chrom_pos").cast("bigint").alias("p"), "sample").agg(F.count(F.lit(1)).alias("n"), F.sum(M.ct_reads()).alias("ct_reads"))
    rows = marks.unionByName(spots, allowMissingColumns=True)
    run = running(rows, ["chrom"], "p", sums={f"_n{i}": F.col(f"_d{i}") for i in each}, peers=True)
    mask = sum(F.when(F.col(f"_n{i}") > 0, 1 << i).otherwise(0) for i in each)
    return run.filter(F.col("n").isNotNull()).groupBy("sample", mask.alias("mask")).agg(F.sum("n").alias("n"), F.sum("ct_reads").alias("ct_reads"))


def overlap_type_counts(features: DataFrame, masters: Sequence[str], others: Sequence[str]) -> DataFrame:
    """For each master type: how many of its features meet each other type, and the share."""
    from lociframe.operators.joins import overlap_filter

    totals = features.groupBy("feat_type").agg(F.count(F.lit(1)).alias("n_master"))
    other = F.explode(F.array(*map(F.lit, others)))
    a = features.filter(F.col("feat_type").isin(list(masters))).withColumn("other_type", other)
    a = a.filter(F.col("other_type") != F.col("feat_type"))
    b = features.filter(F.col("feat_type").isin(list(others))).withColumn("other_type", F.col("feat_type"))
    met = overlap_filter(a, b, keys=["chrom", "other_type"])
    n = met.groupBy("feat_type", "other_type").agg(F.count(F.lit(1)).alias("n_meeting"))
    return n.join(totals, "feat_type").withColumn("share", F.col("n_meeting") / F.col("n_master"))


# --- distance-based correlation -------------------------------------------------


def _meth_pairs(df: DataFrame, max_dist: int, keys: Sequence[str], strand: str) -> DataFrame:
    d = df.withColumn("m", M.frac_meth()).filter(F.col("m").isNotNull())
    p = pairs_within(d, max_dist, keys, "chrom_pos", ["m", "strand"])
    if strand == "same":
        return p.filter(F.col("strand_1") == F.col("strand_2"))
    return p.filter(F.col("strand_1") != F.col("strand_2")) if strand == "opposite" else p


def autocorr_pearson(df: DataFrame, max_dist: int, by: Sequence[str] = ("sample",), strand: str = "any") -> DataFrame:
    """Pearson by distance from running moments in one pass (mean and stdev of the later member).

    Twice the pairs minus one is the divisor; distances with a divisor of 10 or less give NULL.
    """
    p = _meth_pairs(df, max_dist, [*by, "chrom"], strand)
    g = p.groupBy(*by, "dist").agg(
        F.count(F.lit(1)).alias("n"), F.avg("m_2").alias("mu"), F.sum(F.col("m_1") * F.col("m_2")).alias("s12"),
        F.sum(F.col("m_1") + F.col("m_2")).alias("s"), F.avg(F.col("m_2") * F.col("m_2")).alias("sq"))
    var = F.col("sq") - F.col("mu") * F.col("mu")
    z = F.col("s12") - F.col("mu") * F.col("s") + F.col("n") * F.col("mu") * F.col("mu")
    div = 2 * F.col("n") - 1
    r = F.when((div > 10) & (var > 1e-12), z / var / div)
    return g.select(*by, F.col("dist").cast("bigint").alias("dist"), "n", r.alias("pearson"))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the bin [edge, next edge); the last bin also holds its upper edge."""
    out = F.when((value >= edges[0]) & (value < edges[1]), 0)
    for i in range(1, len(edges) - 1):
        out = out.when((value >= edges[i]) & (value < edges[i + 1]), i)
    return out.when(value == edges[-1], len(edges) - 2)


def autocorr_binned(df: DataFrame, max_dist: int, edges: Sequence[float], by: Sequence[str] = ("sample",)) -> DataFrame:
    """Share of pairs ending in bin_2 among all pair members in bin_1, by distance.

    Both members enter the single-bin count; a pair inside one bin counts twice.
    """
    p = _meth_pairs(df, max_dist, [*by, "chrom"], "any").select(
        *by, "dist", bin_of(F.col("m_1"), edges).alias("b1"), bin_of(F.col("m_2"), edges).alias("b2"))
    cells = p.groupBy(*by, "dist", "b1", "b2").agg(F.count(F.lit(1)).alias("n"))
    # both orientations of every cell: the row sums are the single-bin counts
    both = cells.unionByName(cells.select(*by, "dist", F.col("b2").alias("b1"), F.col("b1").alias("b2"), "n"))
    pair = both.groupBy(*by, "dist", "b1", "b2").agg(F.sum("n").alias("n_pair"))
    single = both.groupBy(*by, "dist", "b1").agg(F.sum("n").alias("n_single"))
    out = pair.join(single, [*by, "dist", "b1"])
    return out.select(*by, F.col("dist").cast("bigint").alias("dist"), F.col("b1").alias("bin_1"), F.col("b2").alias("bin_2"),
                      "n_pair", "n_single", (F.col("n_pair") / F.col("n_single")).alias("share"))


def concordance(df: DataFrame, max_dist: int, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Mean absolute methylation difference by distance, for all, same and opposite strand pairs."""
    p = _meth_pairs(df, max_dist, [*by, "chrom"], "any")
    diff, same = F.abs(F.col("m_1") - F.col("m_2")), F.col("strand_1") == F.col("strand_2")
    return p.groupBy(*by, F.col("dist").cast("bigint").alias("dist")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean_diff"),
        F.avg(F.when(same, diff)).alias("mean_diff_same"), F.avg(F.when(~same, diff)).alias("mean_diff_opposite"))


def autocorr_by_read(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Concordance counts by distance of read pairs: M, U and the four combinations."""
    a, b = F.col("meth_1"), F.col("meth_2")
    n = lambda c: F.sum(c.cast("bigint"))
    return pairs.groupBy(*by, F.col("dist").cast("bigint").alias("dist")).agg(
        n(a).alias("n_m"), n(~a).alias("n_u"), n(a & b).alias("n_mm"), n(a & ~b).alias("n_mu"), n(~a & b).alias("n_um"), n(~a & ~b).alias("n_uu"))


# --- allele tests ---------------------------------------------------------------


def contingency(alleles: DataFrame, max_opp_a: float = 0.2, max_opp_a_count: int = 1, only_cpg: bool = True, min_allele: int = 0) -> DataFrame:
    """2 x 2 rows of the deepest variant per cytosine (equal depth: the first position)."""
    a, b = F.col("a_c_reads") + F.col("a_t_reads"), F.col("b_c_reads") + F.col("b_t_reads")
    ok = ((F.col("a_base") != "0") & (F.col("b_base") != "0") & (F.col("a_c_reads") + F.col("b_c_reads") > 0)
          & (F.col("a_t_reads") + F.col("b_t_reads") > 0) & (a >= min_allele) & (b >= min_allele)
          & (F.col("a_reads_opp") / F.nullif(F.col("total_reads_opp"), F.lit(0)) <= max_opp_a))
    if only_cpg:
        ok = ok & (F.col("next_base_ref") == "G")
    keep = ["allele_pos", "a_c_reads", "a_t_reads", "b_c_reads", "b_t_reads", "total_reads_opp", "a_reads_opp"]
    best = F.max_by(F.struct(*keep), F.struct((a + b).alias("t"), (-F.col("allele_pos")).alias("o")))
    rows = alleles.filter(ok).groupBy("chrom", "chrom_pos").agg(best.alias("r")).select("chrom", "chrom_pos", "r.*")
    return rows.filter(~((F.col("total_reads_opp") <= 10) & (F.col("a_reads_opp") > max_opp_a_count)))


def chi_square_stat(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sample statistic of counts (a, b) and (c, d), scaled for unequal totals."""
    w = F.sqrt((c + d).cast("double") / F.nullif(a + b, F.lit(0)))
    term = lambda x, y: F.coalesce(F.pow(x * w - y / F.nullif(w, F.lit(0)), F.lit(2)) / F.nullif(x + y, F.lit(0)), F.lit(0.0))
    return term(a, c) + term(b, d)


def chi_square_log10_p(stat: Column) -> Column:
    """log10 of the upper tail for one degree of freedom; never underflows.

    Below z = 2 the series of the error function, beyond it the continued fraction of its
    complement, both nested, so the logarithm needs no small number to be formed.
    """
    z = F.sqrt(stat / 2)
    series = F.lit(1.0)
    for k in range(40, 0, -1):
        series = 1 + series * (stat / (2 * k + 1))  # 2 z^2 = stat
    body = 1 - F.exp(-stat / 2) * z * series * (2 / math.sqrt(math.pi))
    fraction = z
    for k in range(60, 0, -1):
        fraction = z + (k / 2) / fraction
    far = (-stat / 2 - F.log(fraction) - math.log(math.pi) / 2) / math.log(10)
    return F.when(z < 2, F.log10(body)).otherwise(far)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series at x + 8, shifted back."""
    y = x.cast("double") + 8
    shift = F.log(y - 8)
    for k in range(1, 8):
        shift = shift + F.log(y - 8 + k)
    r = 1 / y
    tail = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - shift


def fisher_two_tailed(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-tailed exact p of a 2 x 2 table of any size.

    Sums the tables with the same margins that are no more likely than the observed one. The walk
    goes from the most likely table outwards, by ratios of neighbours, so errors don't add up to
    more than a rounding per step and the tolerance for equally likely tables is relative. It ends
    60 standard deviations beyond the observed table and its mirror, where nothing is left to add.
    """
    n = a + b + c + d
    r1, r2, c1 = a + b, c + d, a + c
    lf = lambda x: log_gamma(x + 1)
    logw = lambda k: -lf(k) - lf(r1 - k) - lf(c1 - k) - lf(r2 - c1 + k)
    low, high = F.greatest(F.lit(0), c1 - r2), F.least(r1, c1)
    mode = F.greatest(low, F.least(high, F.floor((r1 + 1).cast("double") * (c1 + 1) / (n + 2)).cast("bigint")))
    spread = F.sqrt(r1.cast("double") * r2 / n * c1 / n * (n - c1) / F.greatest(n - 1, F.lit(1)))
    reach = 2 * F.abs(a - mode) + F.ceil(60 * spread) + 60
    # weights are relative to the most likely table
    limit = F.when(a == mode, 1.0).otherwise(F.exp(logw(a) - logw(mode))) * (1 + 1e-7)

    def walk(v: Column, to: Column, sign: int, ratio: Callable[[Column], Column]) -> Column:
        def step(acc: Column, j: Column) -> Column:
            w, k = acc["w"], acc["k"]
            return F.struct(
                (w * ratio(k)).alias("w"), (k + sign).alias("k"), (acc["all"] + w).alias("all"),
                (acc["tail"] + F.when(w <= acc["limit"], w).otherwise(0.0)).alias("tail"), acc["limit"].alias("limit"))

        zero = F.struct(F.lit(1.0).alias("w"), v["mode"].alias("k"), F.lit(0.0).alias("all"), F.lit(0.0).alias("tail"), v["limit"].alias("limit"))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), to), zero, step)

    def both(v: Column) -> Column:
        rising = walk(v, v["up"], 1, lambda k: (v["r1"] - k).cast("double") * (v["c1"] - k) / ((k + 1).cast("double") * (v["gap"] + k + 1)))
        falling = walk(v, v["down"], -1, lambda k: k.cast("double") * (v["gap"] + k) / ((v["r1"] - k + 1).cast("double") * (v["c1"] - k + 1)))
        twice = F.when(v["limit"] >= 1, 1.0).otherwise(0.0)  # both walks begin with the most likely table
        return F.struct((rising["tail"] + falling["tail"] - twice).alias("tail"), (rising["all"] + falling["all"] - 1).alias("all"))

    facts = {"r1": r1, "c1": c1, "gap": r2 - c1, "mode": mode, "up": F.least(high - mode, reach), "down": F.least(mode - low, reach), "limit": limit}
    # through an array of one, so that the walks read these values instead of computing them at every step
    parts = F.transform(F.array(F.struct(*[x.alias(k) for k, x in facts.items()])), both)
    return F.when(n > 0, F.get(F.transform(parts, lambda x: x["tail"] / x["all"]), F.lit(0))).when(n == 0, 1.0)


def log_expectation(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """log2 observed / expected of the larger C count and of the larger T count."""
    n = (a + b + c + d).cast("double")
    side = lambda x, y: F.when(x > y, a + b).otherwise(c + d)
    ratio = lambda x, y: F.greatest(x, y) / F.nullif(side(x, y) * (x + y) / n, F.lit(0))
    log2 = lambda v: F.when(v > 0, F.log2(v))
    return log2(ratio(a, c)), log2(ratio(b, d))


# --- calls against truth, enrichment, genes --------------------------------------


def snp_calls(bases: DataFrame, min_freq: float = 0.2, min_count: int = 2) -> DataFrame:
    """Two most frequent bases per position and whether the position is called heterozygous."""
    n = bases.groupBy(*place(bases)).agg(*[F.sum((F.col("base") == b).cast("bigint")).alias(b) for b in "ACGT"])
    ranked = F.sort_array(F.array(*[F.struct(F.col(b).alias("n"), (-F.ascii(F.lit(b))).alias("o"), F.lit(b).alias("b")) for b in "ACGT"]), asc=False)
    n = n.withColumn("_r", ranked).select(
        "chrom", "pos", sum(F.col(b) for b in "ACGT").alias("depth"), F.col("_r")[0]["b"].alias("base_1"), F.col("_r")[0]["n"].alias("n_1"),
        F.col("_r")[1]["b"].alias("base_2"), F.col("_r")[1]["n"].alias("n_2"))
    rest = F.col("depth") - F.col("n_1")
    deep = F.col("depth") > 10
    freq_ok = (F.col("n_1") / F.col("depth") >= min_freq) & (F.col("n_2") / F.col("depth") >= min_freq)
    het = (F.col("n_1") >= min_count) & (rest >= min_count) & (~deep | freq_ok)
    return n.withColumn("het", het)


def confusion(calls: DataFrame, truth: DataFrame, keys: Sequence[str], call: str, real: str) -> DataFrame:
    """One row: TP, TN, FP, FN and the two error rates of a boolean call."""
    j = calls.join(truth, list(keys))
    n = lambda c: F.sum(c.cast("bigint"))
    a, b = F.col(call), F.col(real)
    g = j.agg(n(a & b).alias("tp"), n(~a & ~b).alias("tn"), n(a & ~b).alias("fp"), n(~a & b).alias("fn"))
    return g.withColumns({"fp_rate": F.col("fp") / F.nullif(F.col("fp") + F.col("tp"), F.lit(0)),
                          "fn_rate": F.col("fn") / F.nullif(F.col("fn") + F.col("tp"), F.lit(0))})


def element_enrichment(points: DataFrame, elements: DataFrame, shift: int, pos: str) -> DataFrame:
    """Points per base over elements and over equally long upstream elements, by type, and their ratio."""
    e = elements.select("feat_type", "chrom", "start_pos", "end_pos", "strand")
    rev = F.col("strand") == "-"
    d = F.when(rev, F.lit(shift)).otherwise(F.lit(-shift))
    up = e.withColumns({"start_pos": F.col("start_pos") + d, "end_pos": F.col("end_pos") + d})
    both = e.withColumn("part", F.lit("inside")).unionByName(up.withColumn("part", F.lit("upstream")))
    sums = interval_sums(points, both, {"n": F.lit(1)}, pos)
    size = F.sum(F.col("end_pos") - F.col("start_pos") + 1)
    g = sums.groupBy("feat_type", "part").agg((F.sum("n") / size).alias("density"))
    pick = lambda p: F.max(F.when(F.col("part") == p, F.col("density")))
    return g.groupBy("feat_type").agg(pick("inside").alias("inside"), pick("upstream").alias("upstream")).withColumn(
        "enrichment", F.col("inside") / F.nullif(F.col("upstream"), F.lit(0)))


def transcripts_to_genes(exons: DataFrame) -> DataFrame:
    """Gene rows from exon rows (gene_id, transcript_id, chrom, strand, start_pos, end_pos)."""
    t = exons.groupBy("gene_id", "transcript_id", "chrom", "strand").agg(
        F.min("start_pos").alias("s"), F.max("end_pos").alias("e"), F.count(F.lit(1)).alias("n_exons"),
        F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: F.concat_ws("-", r["start_pos"].cast("string"), r["end_pos"].cast("string"))), ",")
    t = t.withColumn("iso", F.concat_ws(":", F.col("transcript_id").cast("string"), text))
    return t.groupBy("gene_id", "chrom", "strand").agg(
        F.min("s").alias("start_pos"), F.max("e").alias("end_pos"), F.count(F.lit(1)).alias("n_isoforms"),
        F.sum("n_exons").alias("n_exons"), F.array_join(F.sort_array(F.collect_list("iso")), ";").alias("isoforms"))


def sample_spread(df: DataFrame, keys: Sequence[str] = ("chrom", "chrom_pos")) -> DataFrame:
    """Population variance and range of methylation between the samples of a position."""
    m = M.frac_meth()
    return df.groupBy(*keys).agg(F.count(m).alias("n"), F.var_pop(m).alias("variance"), (F.max(m) - F.min(m)).alias("delta"))


def sample_deltas(df: DataFrame, keys: Sequence[str] = ("chrom", "chrom_pos", "strand")) -> DataFrame:
    """Absolute methylation difference of every two samples at each position: keys, sample_1 < sample_2, delta.

    The list of a position has one entry per sample; its pairs are formed inside the row.
    """
    m = M.frac_meth()
    here = df.filter(m.isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", m.alias("m")))).alias("_l"))
    after = lambda x, i: F.transform(
        F.slice("_l", i + 2, F.size("_l")), lambda y: F.struct(x["sample"].alias("sample_1"), y["sample"].alias("sample_2"), F.abs(x["m"] - y["m"]).alias("delta")))
    return here.filter(F.size("_l") > 1).select(*keys, F.inline(F.flatten(F.transform("_l", after))))
