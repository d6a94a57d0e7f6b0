"""Positional walks: scanning windows, domains, runs, gaps, clusters, stepped windows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import methylation as M
from lociframe.operators.aggregates import FRACTION, neighbour_spans
from lociframe.operators.rangejoin import flanked, interval_sums, pairs_within
from lociframe.session import settle
from lociframe.operators.tiles import (
    TILE, islands, local_chains, merge_intervals, position_halo, row_halo, running, tile_of, tile_window,
)

KEYS = ("sample", "chrom")
BLOCK = 4096


def spatial_weight(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "chrom_pos") -> DataFrame:
    """Distance to the previous position; the minus partner of a CpG takes over its plus partner's."""
    keys = list(keys)
    halo = row_halo(df.select(*keys, pos, "strand"), keys, pos, before=2)
    w = tile_window(keys, pos)
    p1, p2, s1 = F.lag(pos, 1).over(w), F.lag(pos, 2).over(w), F.lag("strand", 1).over(w)
    dist = F.col(pos) - p1
    partner = (dist == 1) & (F.col("strand") == "-") & (s1 == "+")
    weight = F.when(partner, F.coalesce(p1 - p2, F.lit(0))).otherwise(dist)
    return halo.withColumn("weight", weight).filter("_home").select(*keys, pos, "strand", "weight")


def midpoint_weight(ref: DataFrame, keys: Sequence[str] = ("chrom",), pos: str = "chrom_pos") -> DataFrame:
    """Bases between the midpoints to both neighbours; half windows at the ends of a chromosome."""
    keys = list(keys)
    halo = row_halo(ref.select(*keys, pos).distinct(), keys, pos, 1, 1)
    w = tile_window(keys, pos)
    p = F.col(pos)
    lo = F.coalesce(F.floor((F.lag(pos).over(w) + p) / 2), p)
    hi = F.coalesce(F.floor((F.lead(pos).over(w) + p) / 2), p)
    return halo.withColumn("weight", (hi - lo + 1).cast("bigint")).filter("_home").select(*keys, pos, "weight")


def _with_reach(df: DataFrame, keys: list[str], pos: str, span: int, width: int) -> DataFrame:
    """Tiles holding, besides their own rows, all rows up to `span` before them and the one before that."""
    width = max(width, span + 1)
    cols = df.columns
    halo = position_halo(df, pos, span, 0, width)
    row = F.struct(*[F.col(c) for c in cols])
    tiled = df.withColumn("_tile", tile_of(pos, width))
    early = F.col(pos) < (F.col("_tile") + 1) * width - span
    ends = tiled.groupBy(*keys, "_tile").agg(
        F.max_by(F.when(early, row), F.when(early, F.col(pos))).alias("_a"), F.max_by(row, pos).alias("_b"))
    w = Window.partitionBy(*keys).orderBy("_tile")
    older = F.last("_b").over(w.rowsBetween(Window.unboundedPreceding, -2))
    extra = F.when(F.lag("_tile").over(w) == F.col("_tile") - 1, F.coalesce(F.lag("_a").over(w), older)).otherwise(F.lag("_b").over(w))
    more = ends.select(F.col("_tile").alias("_to"), extra.alias("_r")).filter(F.col("_r").isNotNull()).select(
        "_r.*", F.col("_to").alias("_tile"), F.lit(False).alias("_home"))
    return halo.select(*cols, "_tile", "_home").unionByName(more)


def scan_windows(
    df: DataFrame,
    span: int,
    min_count: int,
    sums: dict[str, Column],
    keys: Sequence[str] = KEYS,
    pos: str = "chrom_pos",
    extremes: dict[str, Column] | None = None,
    width: int = TILE,
) -> DataFrame:
    """Trailing windows ending at each position.

    A window keeps one position at or beyond the span, so end - start >= span except at the
    start of a chromosome; windows below span or `min_count` are dropped. Sums are differences
    of growing frames (linear in the rows); `extremes` give <name>_min and <name>_max.
    """
    keys, extremes = list(keys), extremes or {}
    named = {f"_v_{n}": c for n, c in {**sums, **{f"x_{n}": c for n, c in extremes.items()}}.items()}
    exact = [f"_v_{n}" for n in sums]
    base = df.select(*keys, pos, *[(c.cast(FRACTION) if n in exact else c).alias(n) for n, c in named.items()])
    rows = _with_reach(base, keys, pos, span, width)
    w = tile_window(keys, pos)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -span)
    inside = w.rangeBetween(-(span - 1), 0)
    first = F.first(pos).over(upto)
    out = rows.select(
        *keys, pos, "_home",
        F.coalesce(F.max(pos).over(before), first).alias("start_pos"),
        (F.count(F.lit(1)).over(upto) - F.coalesce(F.nullif(F.count(F.lit(1)).over(before), F.lit(0)) - 1, F.lit(0))).alias("n"),
        *[(F.sum(f"_v_{n}").over(upto) - F.coalesce(F.sum(f"_v_{n}").over(before) - F.coalesce(F.last(f"_v_{n}").over(before), F.lit(0)), F.lit(0))).cast("double").alias(n) for n in sums],
        *[F.least(F.min(f"_v_x_{n}").over(inside), F.last(f"_v_x_{n}").over(before)).alias(f"{n}_min") for n in extremes],
        *[F.greatest(F.max(f"_v_x_{n}").over(inside), F.last(f"_v_x_{n}").over(before)).alias(f"{n}_max") for n in extremes],
    ).filter("_home").drop("_home").withColumnRenamed(pos, "end_pos")
    return out.filter((F.col("n") >= min_count) & (F.col("end_pos") - F.col("start_pos") >= span))


def scan_windows_variable(
    df: DataFrame, min_span: int, max_span: int, min_count: int, sums: dict[str, Column],
    keys: Sequence[str] = KEYS, pos: str = "chrom_pos", width: int = TILE,
) -> DataFrame:
    """Windows grown backwards until they hold more than `min_count` positions and reach `min_span`.

    The position that completes the window enters the sums but not the window itself; growth
    stops at `max_span`.
    """
    keys = list(keys)
    base = df.select(*keys, pos, *[F.coalesce(c.cast(FRACTION), F.lit(0).cast(FRACTION)).alias(f"_v_{n}") for n, c in sums.items()])
    rows = position_halo(base, pos, max_span, 0, width)
    w = tile_window(keys, pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        *keys, pos, "_tile", "_home", F.row_number().over(w).alias("_i"), F.lead(pos).over(w).alias("_next"),
        *[F.sum(f"_v_{n}").over(upto).alias(f"_s_{n}") for n in sums],
        *[(F.sum(f"_v_{n}").over(upto) - F.col(f"_v_{n}")).alias(f"_p_{n}") for n in sums])
    far = F.struct(F.col(pos).alias("p"), "_i", "_next", *[f"_p_{n}" for n in sums])
    by_count = F.lag(far, min_count).over(w)
    by_span = F.last(far).over(w.rangeBetween(Window.unboundedPreceding, -min_span))
    out = rows.withColumn("_a", by_count).withColumn("_b", by_span).filter("_home")
    start = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit(None)).when(F.col("_a.p") <= F.col("_b.p"), F.col("_a")).otherwise(F.col("_b"))
    out = out.withColumn("_st", start).filter(F.col("_st").isNotNull() & (F.col(pos) - F.col("_st.p") < max_span))
    return out.select(
        *keys, F.col("_st._next").alias("start_pos"), F.col(pos).alias("end_pos"), (F.col("_i") - F.col("_st._i")).cast("bigint").alias("n"),
        *[(F.col(f"_s_{n}") - F.col(f"_st._p_{n}")).cast("double").alias(n) for n in sums])


def find_domains(windows: DataFrame, passes: Column, score: Column, keys: Sequence[str] = KEYS, min_len: int = 0) -> DataFrame:
    """Passing windows merged while they overlap; the score is that of the first window."""
    keys = list(keys)
    good = windows.filter(passes).withColumn("_score", score)
    chains = local_chains(good, keys, "start_pos", "end_pos", first=F.min(F.struct("end_pos", "_score")), n_windows=F.count(F.lit(1)))
    out = islands(settle(chains), keys, "start_pos", "end_pos").groupBy(*keys, F.col("island").alias("start_pos")).agg(
        F.max("end_pos").alias("end_pos"), F.min("first").alias("first"), F.sum("n_windows").alias("n_windows"))
    return out.filter(F.col("end_pos") - F.col("start_pos") + 1 >= min_len).select(
        *keys, "start_pos", "end_pos", F.col("first._score").alias("score"), "n_windows")


def methylation_windows(df: DataFrame, span: int, min_count: int, weighted: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows with mean methylation (weighted by distance to the previous position when asked)."""
    m = M.frac_meth()
    if weighted:
        df = df.join(spatial_weight(df, keys).select(*keys, "chrom_pos", "weight"), [*keys, "chrom_pos"])
        w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)
        sums = {"_x": m * w, "_w": F.when(m.isNotNull(), w).cast("double")}
    else:
        sums = {"_x": m, "_w": m.isNotNull().cast("double")}
    win = scan_windows(df, span, min_count, sums, keys)
    return win.withColumn("mean", F.when(F.col("_w") > 0.5, F.col("_x") / F.col("_w"))).drop("_x", "_w")


def phasing(df: DataFrame, period: int = 185, flank: int = 20, same_strand: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean absolute difference to earlier positions at half-integer and at integer periods."""
    d = df.withColumn("m", M.frac_meth()).filter(F.col("m").isNotNull())
    half, whole = (round(1.5 * period), round(2.5 * period)), (period, 2 * period)
    near = lambda c: F.col("dist").between(c - flank, c + flank)
    off_phase = near(half[0]) | near(half[1])
    in_phase = ~off_phase & (near(whole[0]) | near(whole[1]))
    p = pairs_within(d, max(half[1], whole[1]) + flank, keys, "chrom_pos", ["m", "strand"], min_dist=max(1, period - flank))
    if same_strand:
        p = p.filter(F.col("strand_1") == F.col("strand_2"))
    diff = F.abs(F.col("m_1") - F.col("m_2"))
    return p.filter(off_phase | in_phase).groupBy(*keys, F.col("pos_2").alias("chrom_pos")).agg(
        F.avg(F.when(off_phase, diff)).alias("off_phase"), F.avg(F.when(in_phase, diff)).alias("in_phase"))


def window_track(windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mid-to-mid spans carrying each window's mean in percent; first and last windows have no span."""
    keys = list(keys)
    mid = F.floor((F.col("start_pos") + F.col("end_pos") + 1) / 2).cast("bigint")
    d = windows.select(*keys, "end_pos", mid.alias("mid"), F.floor(F.round(F.lit(100.0) * F.col("mean"), 9) + 0.5).cast("bigint").alias("value"))
    halo = row_halo(d, keys, "end_pos", 1, 1)
    w = tile_window(keys, "end_pos")
    half = lambda other: F.floor((F.col("mid") + other) / 2)
    out = halo.withColumns({"span_start": half(F.lag("mid").over(w)) + 1, "span_end": half(F.lead("mid").over(w))})
    return out.filter(F.col("_home") & F.col("span_start").isNotNull() & F.col("span_end").isNotNull()).select(
        *keys, "span_start", "span_end", "value")


def smooth(track: DataFrame, window: int, min_avg: float = 0.0, read_length: int = 0, step: int = 1,
           keys: Sequence[str] = ("chrom",), pos: str = "pos", value: str = "value") -> DataFrame:
    """Moving average of a sparse track, reported at window centres (divided by `step`).

    As the windows slide on, only values from the first window end onward have entered; early
    windows divide by what they hold. Zero averages are left out.
    """
    keys = list(keys)
    half = (window + 1) // 2 - 1
    ends = track.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    d = track.join(ends, keys).filter(F.col(pos) >= F.col("_lo") + window - 1)
    p = F.col(pos)
    # window ends p .. p+window-1 whose centre is a multiple of step
    shift = half - window + 1
    first = (F.ceil((p + shift) / step) * step).cast("bigint")
    last = F.least(p + window - 1, F.col("_hi")).cast("bigint") + shift
    d = d.withColumn("_n", F.floor((last - first) / step)).filter(F.col("_n") >= 0)
    rows = d.withColumn("_c", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n")), lambda i: first + i * step)))
    g = rows.groupBy(*keys, "_c", "_lo").agg(F.sum(value).alias("_t"))
    held = F.least(F.lit(window), F.col("_c") - shift - (F.col("_lo") + window - 1) + 1)
    avg = F.col("_t") / (F.lit(read_length) if read_length > 0 else held)
    return g.select(*keys, F.floor(F.col("_c") / step).alias(pos), avg.alias(value)).filter((F.col(value) != 0) & (F.col(value) > min_avg))


def stepped_centres(sizes: DataFrame, step: int, start: int = 1, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Centres start, start+step, ... up to the chromosome length (one row per centre).

    A chromosome is cut into blocks of centres, which are dealt out before they are written out.
    """
    big = lambda v: F.lit(v).cast("bigint")
    end = F.col("length").cast("bigint")
    blocks = sizes.select(*keys, F.col("length").alias("chrom_end"), end.alias("_end"), F.explode(F.sequence(big(start), end, big(step * BLOCK))).alias("_block"))
    last = F.least(F.col("_block") + big(step * (BLOCK - 1)), F.col("_end"))
    return blocks.repartition(*keys, "_block").select(*keys, "chrom_end", F.explode(F.sequence(F.col("_block"), last, big(step))).alias("centre"))


def stepped_density(cytosines: DataFrame, sizes: DataFrame, window: int, step: int, start: int = 1, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """CpGs (two cytosines each) per window base in percent, and mean methylation, per stepped centre."""
    half = window // 2
    c = stepped_centres(sizes, step, start, keys)
    c = c.withColumns({"start_pos": F.greatest(F.col("centre") - half, F.lit(start)), "end_pos": F.least(F.col("centre") + half - 1, F.col("chrom_end"))})
    m = M.frac_meth().cast(FRACTION)
    s = interval_sums(cytosines, c, {"n": F.lit(1), "_m": m, "_k": m.isNotNull().cast("bigint")}, "chrom_pos", keys)
    dens = F.floor(100.0 * (F.col("n") / 2.0) / (F.col("end_pos") - F.col("start_pos") + 1) + 0.5).cast("bigint")
    return s.select(*keys, "centre", F.col("n").cast("bigint").alias("n"), dens.alias("density"),
                    (F.col("_m").cast("double") / F.nullif(F.col("_k"), F.lit(0))).alias("mean_meth"))


def stretch_windows(aligned: DataFrame, sizes: DataFrame, window: int, jump: int, max_window: int, step: int, min_count: int,
                    samples: tuple[str, str], start: int = 1) -> DataFrame:
    """Per stepped centre the narrowest window with enough shared positions: means of both samples and their difference.

    aligned: chrom, chrom_pos, m_<sample> columns. All widths are answered by the same running sums.
    """
    a, b = samples
    c = stepped_centres(sizes, step, start).withColumn("width", F.explode(F.array(*map(F.lit, range(window, max_window + 1, jump)))))
    flank = F.floor(F.col("width") / 2)
    c = c.withColumns({"start_pos": F.col("centre") - flank, "end_pos": F.col("centre") + flank})
    s = interval_sums(aligned, c, {"n": F.lit(1), "_a": F.col(f"m_{a}").cast(FRACTION), "_b": F.col(f"m_{b}").cast(FRACTION)}, "chrom_pos")
    s = s.filter(F.col("n") >= min_count)
    best = s.groupBy("chrom", "centre").agg(F.min(F.struct("width", "n", "_a", "_b")).alias("r"))
    mean = lambda k: F.col(f"r.{k}").cast("double") / F.col("r.n")
    return best.select("chrom", "centre", F.col("r.width").alias("width"), F.col("r.n").cast("bigint").alias("n"),
                       mean("_a").alias(f"mean_{a}"), mean("_b").alias(f"mean_{b}"), (mean("_b") - mean("_a")).alias("delta"))


def boundary_density(centres: DataFrame, points: DataFrame, window: int, n_windows: int, auto_flip: bool = True, pos: str = "chrom_pos") -> DataFrame:
    """Counts in `n_windows` windows each side of a centre (skipped itself), denser side turned to the right.

    centres: id, chrom, centre.
    """
    k = F.explode(F.sequence(F.lit(-n_windows), F.lit(n_windows - 1)))
    w = centres.withColumn("k", k)
    lo = F.col("centre") + F.col("k") * window + F.when(F.col("k") >= 0, 1).otherwise(0)
    w = w.withColumns({"start_pos": lo, "end_pos": lo + window - 1})
    s = interval_sums(points, w, {"n": F.lit(1)}, pos)
    row = s.groupBy("id", "chrom", "centre").agg(
        F.sum(F.when(F.col("k") < 0, -F.col("n")).otherwise(F.col("n"))).alias("balance"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("n").cast("bigint").alias("n")))), lambda x: x["n"]).alias("counts"))
    counts = F.when(F.lit(auto_flip) & (F.col("balance") < 0), F.reverse("counts")).otherwise(F.col("counts"))
    return row.select("id", "chrom", "centre", F.col("balance").cast("bigint").alias("balance"), counts.alias("counts"))


def peak_runs(track: DataFrame, passes: Column, half_span: int, min_count: int, keys: Sequence[str] = ("chrom",), pos: str = "pos") -> DataFrame:
    """Runs of consecutive passing rows, widened by half a span; a run ends at any failing row."""
    keys = list(keys)
    d = track.withColumn("_ok", F.coalesce(passes, F.lit(False)))
    run = running(d, keys, pos, maxes={"_brk": F.when(~F.col("_ok"), F.col(pos))}).filter("_ok")
    g = run.groupBy(*keys, "_brk").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count(F.lit(1)).alias("n"))
    lo = F.col("lo") - half_span
    return g.filter(F.col("n") >= min_count).select(
        *keys, F.when(lo == 0, 1).otherwise(lo).alias("start_pos"), (F.col("hi") + half_span).alias("end_pos"), "n")


def fill_gaps(features: DataFrame, max_gap: int = 5000) -> DataFrame:
    """Starts moved to the previous end + 1 when the gap in front is not longer than `max_gap`."""
    f = neighbour_spans(features)
    gap = F.col("start_pos") - F.col("prev_end")
    moved = F.when((gap >= 0) & (gap <= max_gap), F.col("prev_end") + 1).otherwise(F.col("start_pos"))
    return f.withColumn("filled_start", moved).select(*features.columns, "filled_start")


def complement(features: DataFrame, flank: int = 0, merged: bool = False) -> DataFrame:
    """Gaps between consecutive features widened by `flank`.

    By default only the record just before counts; `merged` also respects longer earlier ones.
    """
    f = flanked(features.select("chrom", "start_pos", "end_pos"), flank)
    f = merge_intervals(f, ["chrom"]) if merged else f.distinct()
    f = neighbour_spans(f)
    return f.filter(F.col("prev_end") < F.col("start_pos")).select(
        "chrom", (F.col("prev_end") + 1).alias("gap_start"), (F.col("start_pos") - 1).alias("gap_end")).filter(
        F.col("gap_start") <= F.col("gap_end"))


def cluster(features: DataFrame, max_dist: int, min_members: int = 1, min_score: float | None = None, max_size: int = 0) -> DataFrame:
    """Chains of features closer than `max_dist` (start minus cluster end), merged into one record each.

    Features below `min_score` break a chain and do not enter. With `max_size` a chain is also cut
    when a member would end further than that from the cluster start (copies of one span stay
    together).
    """
    score = F.col("score").cast("double") if "score" in features.columns else F.lit(0.0)
    ok = F.lit(True) if min_score is None else score >= min_score
    spans = features.withColumn("_ok", ok).groupBy("chrom", "start_pos", "end_pos", "_ok").agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("score"))
    keys = ["chrom"]
    if min_score is not None:
        brk = spans.groupBy("chrom", "start_pos").agg(F.max(F.when(~F.col("_ok"), F.col("start_pos"))).alias("_f"))
        brk = running(brk, ["chrom"], "start_pos", inclusive=False, maxes={"_brk": F.col("_f")})
        spans = spans.filter("_ok").join(brk.select("chrom", "start_pos", "_brk"), ["chrom", "start_pos"]).withColumn(
            "_brk", F.coalesce("_brk", F.lit(-1)))
        keys = ["chrom", "_brk"]
    lab = islands(spans, keys, "start_pos", "end_pos", gap=max_dist + 1)
    if max_size > 0:
        lab = _cut_by_size(lab, [*keys, "island"], max_dist, max_size)
        keys = [*keys, "island", "_cut"]
    else:
        keys = [*keys, "island"]
    out = lab.groupBy(*keys).agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
                                 F.sum("n").alias("n"), F.sum("score").alias("score"))
    return out.filter(F.col("n") >= min_members).select("chrom", "start_pos", "end_pos", "n", "score")


def _cut_by_size(spans: DataFrame, keys: list[str], max_dist: int, max_size: int) -> DataFrame:
    """Adds `_cut`, the first span of the cluster that a greedy walk of each chain puts a span into.

    Where a cluster ends depends on its first span alone, so the walk is a path along links from
    first span to first span. A task follows the links of a tile to the span by which the path
    leaves it, for every span that it could enter by. Of the spans that are left, entries of a tile
    that some path takes, a path of any length is found by doubling its steps; then tasks mark the
    path inside their tiles. Neither a chain nor a chromosome is walked by one task. Chains that are
    no longer than `max_size` stay whole.
    """
    span = F.struct("start_pos", "end_pos")
    first = F.min(span)
    sizes = spans.groupBy(*keys).agg(first.alias("_root"), F.max("end_pos").alias("_far"))
    lab = settle(spans.join(sizes, keys))
    whole = F.col("_far") - F.col("_root.start_pos") <= max_size
    short = lab.filter(whole).withColumn("_cut", F.col("_root")).drop("_root", "_far")
    long = lab.filter(~whole).drop("_far")

    halo = row_halo(long.select(*keys, "start_pos", "end_pos", "_root"), keys, "start_pos", after=1, order=["start_pos", "end_pos"])
    w = tile_window(keys, "start_pos", "end_pos")
    rows = halo.withColumns({"_ns": F.lead("start_pos").over(w), "_ne": F.lead("end_pos").over(w)}).filter("_home").drop("_home", "_tile")
    rows = position_halo(rows, "start_pos", 0, max_size + max_dist + 1)
    kinds = ", ".join(f"{k} {spans.schema[k].dataType.simpleString()}" for k in keys)
    width = max(TILE, max_size + max_dist + 2)

    def links(group: pa.Table) -> pa.Table:
        t = group.sort_by([(c, "ascending") for c in (*keys, "start_pos", "end_pos")])
        chain = list(zip(*[t.column(k).to_pylist() for k in keys]))
        s, e, ns, ne, home = (t.column(c).to_pylist() for c in ("start_pos", "end_pos", "_ns", "_ne", "_home"))
        out: list[tuple | None] = [None] * len(s)  # next first span, span by which the path leaves the tile
        for i in range(len(s) - 1, -1, -1):
            if not home[i]:
                continue
            last, reach = i, e[i]
            while last + 1 < len(s) and chain[last + 1] == chain[i] and e[last + 1] - s[i] <= max_size and s[last + 1] - reach <= max_dist:
                last += 1
                reach = max(reach, e[last])
            at, follow = last + 1, (ns[last], ne[last])
            inside = at < len(s) and home[at] and chain[at] == chain[i]
            out[i] = (follow, out[at][1] if inside else follow)
        kept = [i for i in range(len(s)) if home[i]]
        whole = t.select([*keys, "start_pos", "end_pos", "_root"]).take(pa.array(kept, pa.int64()))
        kind = t.schema.field("start_pos").type
        for k, name in enumerate(("_ns", "_ne", "_xs", "_xe")):
            whole = whole.append_column(name, pa.array([out[i][k // 2][k % 2] for i in kept], kind))
        return whole

    start_kind, end_kind = (spans.schema[c].dataType.simpleString() for c in ("start_pos", "end_pos"))
    schema = f"{kinds}, start_pos {start_kind}, end_pos {end_kind}, _root struct<start_pos:{start_kind},end_pos:{end_kind}>, _ns {start_kind}, _ne {start_kind}, _xs {start_kind}, _xe {start_kind}"
    linked = settle(rows.groupBy("chrom", "_tile").applyInArrow(links, schema))

    # from tile to tile: the entries that the paths take
    leaves = linked.filter(F.col("_xs").isNotNull())
    seen = settle(leaves.filter(F.col("_root") == span).select(*keys, F.col("_xs").alias("s"), F.col("_xe").alias("e")))
    targets = leaves.select(*keys, F.col("_xs").alias("start_pos"), F.col("_xe").alias("end_pos")).distinct()
    hops = settle(leaves.join(targets, [*keys, "start_pos", "end_pos"], "left_semi").select(*keys, F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), F.col("_xs").alias("s2"), F.col("_xe").alias("e2")))
    while not hops.isEmpty():
        seen = settle(seen.unionByName(seen.join(hops, [*keys, "s", "e"]).select(*keys, F.col("s2").alias("s"), F.col("e2").alias("e"))).distinct())
        on = hops.select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("s2").alias("s3"), F.col("e2").alias("e3"))
        hops = settle(hops.join(on, [*keys, "s2", "e2"]).select(*keys, "s", "e", F.col("s3").alias("s2"), F.col("e3").alias("e2")))

    entries = seen.select(*keys, F.col("s").alias("start_pos"), F.col("e").alias("end_pos"), F.lit(True).alias("_entry"))
    marked = linked.join(entries, [*keys, "start_pos", "end_pos"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(False)) | (F.col("_root") == span))
    marked = marked.select(*keys, "start_pos", "end_pos", "_ns", "_ne", "_entry", tile_of("start_pos", width).alias("_tile"))

    def path(group: pa.Table) -> pa.Table:
        chain = list(zip(*[group.column(k).to_pylist() for k in keys]))
        s, e, ns, ne, entry = (group.column(c).to_pylist() for c in ("start_pos", "end_pos", "_ns", "_ne", "_entry"))
        at = {(c, x, y): i for i, (c, x, y) in enumerate(zip(chain, s, e))}
        on = [False] * len(s)
        for i in range(len(s)):
            k = i if entry[i] else None
            while k is not None and not on[k]:
                on[k] = True
                k = at.get((chain[k], ns[k], ne[k]))
        return group.select([*keys, "start_pos", "end_pos"]).append_column("_first", pa.array(on, pa.bool_()))

    firsts = marked.groupBy("chrom", "_tile").applyInArrow(path, f"{kinds}, start_pos {start_kind}, end_pos {end_kind}, _first boolean")
    cut = running(firsts, keys, "start_pos", order=["start_pos", "end_pos"], maxes={"_cut": F.when(F.col("_first"), span)}).drop("_first")
    return short.unionByName(long.drop("_root").join(cut, [*keys, "start_pos", "end_pos"]))
