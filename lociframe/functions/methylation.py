"""Column expressions over cytosine counts. Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default limits of the count filters.
MAX_OPP_A = 0.101
MUTATION_MIN_FRAC = 0.2
MUTATION_MIN_READS = 2
CONTEXT_MIN_MATCH = 0.899


def _ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def ct_reads(use_nonconv_filter: bool = True) -> Column:
    """C+T reads; with the filter on, nonconverted C reads are left out."""
    total = F.col("c_reads") + F.col("t_reads")
    return total if use_nonconv_filter else total + F.col("c_reads_nonconv")


def total_reads() -> Column:
    return F.col("c_reads") + F.col("c_reads_nonconv") + F.col("t_reads") + F.col("ag_reads")


def frac_meth(use_nonconv_filter: bool = True) -> Column:
    c = F.col("c_reads") if use_nonconv_filter else F.col("c_reads") + F.col("c_reads_nonconv")
    return _ratio(c, c + F.col("t_reads"))


def frac_c_or_t() -> Column:
    ct = ct_reads(False)
    return _ratio(ct, ct + F.col("ag_reads"))


def opp_a_of_total() -> Column:
    """Opposite-strand A share as the scan filter counts it: a / total."""
    return _ratio(F.col("a_reads_opp"), F.col("total_reads_opp"))


def opp_a_of_sum() -> Column:
    """Opposite-strand A share as the mutation test counts it: a / (a + total)."""
    return _ratio(F.col("a_reads_opp"), F.col("a_reads_opp") + F.col("total_reads_opp"))


def min_ct(n: int, use_nonconv_filter: bool = True) -> Column:
    return ct_reads(use_nonconv_filter) >= n


def opp_a_ok(limit: float = MAX_OPP_A) -> Column:
    return (F.col("total_reads_opp") == 0) | (opp_a_of_total() <= limit)


def next_g_ok(limit: float = MAX_OPP_A) -> Column:
    share = _ratio(F.col("next_base_g"), F.col("next_base_total"))
    return (F.col("next_base_total") == 0) | (share >= 1 - limit)


def not_mutated(min_frac: float = MUTATION_MIN_FRAC, min_reads: int = MUTATION_MIN_READS) -> Column:
    """False only when the A share and the A count both reach their limits."""
    fails = (F.coalesce(opp_a_of_sum(), F.lit(-1.0)) >= min_frac) & (F.col("a_reads_opp") >= min_reads)
    return ~fails


def is_cph(only_ref: bool, max_next_g: float = 0.5) -> Column:
    by_ref = F.col("next_base_ref") != "G"
    if only_ref:
        return by_ref
    share = _ratio(F.col("next_base_g"), F.col("next_base_total"))
    return F.when(F.col("next_base_total") > 0, share < max_next_g).otherwise(by_ref)


def context_call(ref: Column, majority: Column, match_frac: Column, min_match: float = CONTEXT_MIN_MATCH) -> Column:
    """Neighbour base: the reference when known, else the majority base, N when reads disagree."""
    base = F.when(ref.isNull() | (ref == "N"), majority).otherwise(ref)
    return F.when(match_frac.isNull() | (match_frac >= min_match), base).otherwise(F.lit("N"))


def meth_colour(m: Column) -> Column:
    """Display colour: grey near one half, red above, green below, cream when missing."""
    step = F.floor(F.lit(10.0) * F.abs(m - 0.5) * 2.0)
    shade = F.when(step == 0, 0).when(step <= 3, 1).when(step <= 7, 2).otherwise(3)
    # Display colours, by shade.
    red = F.array(*map(F.lit, ["153,153,153", "255,153,153", "255,102,102", "255,0,0"]))
    green = F.array(*map(F.lit, ["153,153,153", "153,255,153", "102,255,102", "0,255,0"]))
    picked = F.get(F.when(m > 0.5, red).otherwise(green), shade)
    return F.when(m.isNull(), F.lit("255,255,204")).otherwise(picked)
