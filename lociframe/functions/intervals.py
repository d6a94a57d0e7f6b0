"""Column expressions over closed 1-based intervals (start_pos, end_pos, strand)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(start: Column, end: Column) -> Column:
    return end - start + 1


def centre(start: Column, end: Column) -> Column:
    """Midpoint, halves rounded up."""
    return F.floor((start + end + 1) / 2).cast("int")


def anchor(start: Column, end: Column, strand: Column, at: str = "center") -> Column:
    """Alignment point: strand-aware `start` / `end`, or `center`."""
    if at == "center":
        return centre(start, end)
    rev = F.coalesce(strand == "-", F.lit(False))
    first, second = (end, start) if at == "start" else (start, end)
    return F.when(rev, first).otherwise(second)


def flank_bounds(start: Column, end: Column, strand: Column, flank: int, at: str = "center", censor: bool = False):
    """(low, high) around the anchor; censoring stops at the feature edge on its inner side."""
    point = anchor(start, end, strand, at)
    low, high = point - flank, point + flank
    if not censor:
        return low, high
    low_in, high_in = F.greatest(start, low), F.least(end, high)
    if at == "center":
        return low_in, high_in
    rev = F.coalesce(strand == "-", F.lit(False))
    keeps_low = rev if at == "start" else ~rev
    return F.when(keeps_low, low_in).otherwise(low), F.when(keeps_low, high).otherwise(high_in)


def relative_region(start: Column, end: Column, strand: Column, rel_start: int, rel_end: int) -> tuple[Column, Column]:
    """Region at fixed offsets around the midpoint (rounded down), mirrored on the minus strand."""
    mid = F.floor((start + end) / 2).cast("int")
    rev = F.coalesce(strand == "-", F.lit(False))
    return (
        F.when(rev, mid - rel_end).otherwise(mid + rel_start),
        F.when(rev, mid - rel_start).otherwise(mid + rel_end),
    )


def overlap_bases(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def frac_overlap(s1: Column, e1: Column, s2: Column, e2: Column, denominator: str) -> Column:
    """Shared bases over `first`, `union`, `smaller` or `larger`."""
    both, a, b = overlap_bases(s1, e1, s2, e2), span(s1, e1), span(s2, e2)
    den = {"first": a, "union": a + b - both, "smaller": F.least(a, b), "larger": F.greatest(a, b)}[denominator]
    return both.cast("double") / den


def fixed_bin(pos: Column, width: int) -> Column:
    return (F.floor(pos / width) * width).cast("bigint")


def signed_distance(ts: Column, te: Column, fs: Column, fe: Column, fstrand: Column, strand_relative: bool = True):
    """Distance target -> feature: negative when the target lies upstream of the feature, 0 on overlap."""
    before = F.when(fs > te, te - fs).when(fe < ts, ts - fe).otherwise(F.lit(0))
    if not strand_relative:
        return before
    return F.when(F.coalesce(fstrand == "-", F.lit(False)), -before).otherwise(before)


def chrom_number(chrom: Column) -> Column:
    """Natural order of chromosome names: 1..n, then X=23, Y=24, M=25; others last."""
    tail = F.upper(F.regexp_replace(chrom, "(?i)^chr", ""))
    return (
        F.when(tail == "X", 23).when(tail == "Y", 24).when(tail.isin("M", "MT"), 25)
        .when(tail.rlike("^[0-9]{1,9}$"), tail.try_cast("int")).otherwise(1000)
    )


def chrom_name(number: Column) -> Column:
    special = F.when(number == 23, "X").when(number == 24, "Y").when(number == 25, "M")
    return F.concat(F.lit("chr"), special.otherwise(number.cast("string")))
