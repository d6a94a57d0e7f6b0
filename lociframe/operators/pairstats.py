"""CpG pairs read from both strands: their record of 29 statistics, filters and trailing windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.tiles import position_halo, tile_window

COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}
SIDES = ("fw", "rev")
STATS = tuple(f"{side}_{name}" for side in SIDES for name in ("depth", "depth_collapsed", "meth", "meth_collapsed", "snp", "snp_collapsed")) + (
    "meth_overall", *(f"snv{k}_{b.lower()}" for k in (1, 2, 3, 4) for b in "ACTG"))


def pair_state(bases: DataFrame) -> DataFrame:
    """chrom, pos of the C and counts of read bases per side, strand and base: all (`n_`) and once per alignment start (`u_`).

    Bases are in reference direction; rows at the G (pos + 1) are the reverse side. Reads that share
    strand and cycle at a place start together; of those the one with the lowest read id is counted
    once. Counts of disjoint sets of places, or of reads with different starts, add up.
    """
    pair = F.when(F.col("ref_base") == "C", F.col("pos")).otherwise(F.col("pos") - 1)
    side = F.when(F.col("ref_base") == "C", "fw").otherwise("rev")
    rows = bases.filter(F.col("ref_base").isin("C", "G")).select("chrom", pair.alias("pos"), side.alias("side"), "strand", "cycle", "read_id", "base")
    alike = rows.groupBy("chrom", "pos", "side", "strand", "cycle").agg(
        *[F.count(F.when(F.col("base") == b, 1)).alias(b) for b in "ACGT"], F.count(F.lit(1)).alias("depth"), F.min_by("base", "read_id").alias("one"))
    sums = []
    for s in SIDES:
        for strand, tag in (("+", "p"), ("-", "m")):
            here = (F.col("side") == s) & (F.col("strand") == strand)
            for b in "ACGT":
                sums += [F.sum(F.when(here, F.col(b)).otherwise(0)).alias(f"n_{s}_{tag}_{b}"), F.count(F.when(here & (F.col("one") == b), 1)).alias(f"u_{s}_{tag}_{b}")]
            sums += [F.sum(F.when(here, F.col("depth")).otherwise(0)).alias(f"n_{s}_{tag}_N"), F.count(F.when(here, 1)).alias(f"u_{s}_{tag}_N")]
    both = F.count(F.when(F.col("side") == "fw", 1)), F.count(F.when(F.col("side") == "rev", 1))
    out = alike.groupBy("chrom", "pos").agg(*sums, *[c.alias(f"rows_{s}") for s, c in zip(SIDES, both)])
    return out.filter("rows_fw > 0 and rows_rev > 0").drop("rows_fw", "rows_rev")


def pair_statistics(state: DataFrame, collapsed: bool = False) -> DataFrame:
    """The 29 statistics of each pair, seen along the strand of each C.

    Depths count all reads of the C's strand. A variant's share speaks of reads with G or A on either
    strand, or T on the other one, against C; null without such reads, as is methylation without
    C and T. `collapsed` takes the overall methylation and the base counts once per alignment start.
    """
    def count(kind: str, side: str, own: bool, base: str) -> Column:
        """Reads with `base` as seen along the C's strand; own: on that strand."""
        tag = "p" if (side == "fw") == own else "m"
        return F.col(f"{kind}_{side}_{tag}_{base if side == 'fw' else COMPLEMENT.get(base, base)}")

    def meth(kind: str, side: str) -> Column:
        c, t = count(kind, side, True, "C"), count(kind, side, True, "T")
        return c / F.nullif(c + t, F.lit(0))

    def snp(kind: str, side: str) -> Column:
        against = sum(count(kind, side, own, b) for own in (True, False) for b in "GA") + count(kind, side, False, "T")
        return against / F.nullif(against + count(kind, side, True, "C") + count(kind, side, False, "C"), F.lit(0))

    out: dict[str, Column] = {}
    for s in SIDES:
        out |= {f"{s}_depth": count("n", s, True, "N"), f"{s}_depth_collapsed": count("u", s, True, "N"), f"{s}_meth": meth("n", s), f"{s}_meth_collapsed": meth("u", s),
                f"{s}_snp": snp("n", s), f"{s}_snp_collapsed": snp("u", s)}
    kind = "u" if collapsed else "n"
    depth = {s: count(kind, s, True, "N") for s in SIDES}
    part = lambda s: F.when(depth[s] > 0, F.coalesce(meth(kind, s), F.lit(0.0)) * depth[s]).otherwise(0.0)
    total = depth["fw"] + depth["rev"]
    out["meth_overall"] = F.when(total > 0, (part("fw") + part("rev")) / F.nullif(total, F.lit(0))).otherwise(0.0)
    # plus reads at the C, plus reads at the G, then minus reads at the G and at the C as the minus strand reads them
    for k, (side, tag, flip) in enumerate((("fw", "p", False), ("rev", "p", False), ("rev", "m", True), ("fw", "m", True)), 1):
        out |= {f"snv{k}_{b.lower()}": F.col(f"{kind}_{side}_{tag}_{COMPLEMENT[b] if flip else b}") for b in "ACTG"}
    return state.select("chrom", "pos", *[out[s].alias(s) for s in STATS])


def without_variants(pairs: DataFrame, fw: float = 0.1, rev: float = 0.1) -> DataFrame:
    """Drop pairs that look like a variant on either side; a side without informative reads passes."""
    likely = (F.coalesce("fw_snp", F.lit(0.0)) >= fw) | (F.coalesce("rev_snp", F.lit(0.0)) > rev)
    return pairs.filter(~likely)


def trailing_windows(df: DataFrame, size: int, values: Sequence[str], keys: Sequence[str] = ("chrom",), pos: str = "pos") -> DataFrame:
    """Each row with `n_before`, the rows less than `size` bases before it, and the mean of each value over them and itself.

    Means leave out nulls. Positions are unique per `keys`; the frame ends before the current row
    for the count, and a halo of the tile holds what it looks back on.
    """
    rows = position_halo(df, pos, size - 1)
    w = tile_window(list(keys), pos)
    before, upto = w.rangeBetween(-(size - 1), -1), w.rangeBetween(-(size - 1), Window.currentRow)
    out = rows.withColumns({"n_before": F.count(F.lit(1)).over(before), **{f"mean_{v}": F.avg(v).over(upto) for v in values}})
    return out.filter("_home").drop("_home", "_tile")


def cycle_shift(bases: DataFrame, size: int, low: tuple[int, int], medium: tuple[int, int], strand: str = "+") -> DataFrame:
    """Converted share of early and later cycles over each cytosine's trailing window, itself included, and their difference.

    Reads of the cytosine's own strand count. Rows where both shares exist and differ by less than 1.
    """
    ref, c, t = ("C", "C", "T") if strand == "+" else ("G", "G", "A")
    rows = bases.filter((F.col("strand") == strand) & (F.col("ref_base") == ref))
    within = lambda span: F.col("cycle").between(*span)
    spots = rows.groupBy("chrom", "pos").agg(*[
        F.count(F.when(within(span) & (F.col("base") == b), 1)).alias(f"{name}_{what}") for name, span in (("low", low), ("medium", medium)) for what, b in (("c", c), ("t", t))])
    halo = position_halo(spots, "pos", size - 1)
    w = tile_window(["chrom"], "pos").rangeBetween(-(size - 1), Window.currentRow)
    total = lambda n: F.sum(n).over(w)
    share = lambda n: total(f"{n}_t") / F.nullif(total(f"{n}_t") + total(f"{n}_c"), F.lit(0))
    out = halo.withColumns({"low_share": share("low"), "medium_share": share("medium")}).filter("_home")
    out = out.select("chrom", "pos", "low_share", "medium_share", (F.col("medium_share") - F.col("low_share")).alias("shift"))
    return out.filter((F.col("shift") != 0) & (F.abs("shift") < 1))
