"""Cytosine count tables: scan, read-level fold, emission rule, partitioned writer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import methylation as M


def in_ranges(ranges: Sequence[tuple[str, int, int]], chrom: str = "chrom", pos: str = "chrom_pos") -> Column:
    """OR of closed ranges; reaches the file scan as pushed filters."""
    tests = [(F.col(chrom) == c) & F.col(pos).between(s, e) for c, s, e in ranges]
    return reduce(lambda a, b: a | b, tests)


def scan(
    df: DataFrame,
    samples: Sequence[str] | None = None,
    ranges: Sequence[tuple[str, int, int]] | None = None,
    min_ct: int = 0,
    use_nonconv_filter: bool = True,
    max_opp_a: float | None = None,
    max_next_non_g: float | None = None,
) -> DataFrame:
    """Filtered cytosine rows. No range filter is added when none is asked for."""
    if samples:
        df = df.filter(F.col("sample").isin(list(samples)))
    if ranges:
        df = df.filter(in_ranges(ranges))
    if min_ct > 0:
        df = df.filter(M.min_ct(min_ct, use_nonconv_filter))
    if max_opp_a is not None:
        df = df.filter(M.opp_a_ok(max_opp_a))
    if max_next_non_g is not None:
        df = df.filter(M.next_g_ok(max_next_non_g))
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Table written by `write_table`; sample and chrom filters prune folders."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, files_per_chrom: int = 1) -> None:
    """Partitioned by sample and chrom; a chromosome is spread over several files by position."""
    spread = F.pmod(F.floor(F.col("chrom_pos") / (1 << 22)), F.lit(files_per_chrom))
    (df.repartition("sample", "chrom", spread).sortWithinPartitions("sample", "chrom", "chrom_pos")
       .write.mode("overwrite").partitionBy("sample", "chrom").parquet(path))


def emit_rule(min_cph_coverage: int = 10, min_cph_frac: float = 0.2) -> Column:
    """CpGs always; other cytosines only with enough reads and methylation (missing share passes)."""
    enough = (M.total_reads() >= min_cph_coverage) & (F.coalesce(M.frac_meth(True), F.lit(1.0)) >= min_cph_frac)
    return (F.col("next_base_ref") == "G") | enough


def fold_reads(reads: DataFrame, keys: Sequence[str] = ("chrom", "chrom_pos", "strand"), keep_reads: bool = False) -> DataFrame:
    """Read-level rows to one count row per position.

    `keep_reads` also nests the reads; leave it off unless the depth per position is bounded.
    """
    aggs = [F.sum(c).alias(c) for c in ("c_reads", "c_reads_nonconv", "t_reads", "ag_reads")]
    if keep_reads:
        aggs.append(F.sort_array(F.collect_list("read_id")).alias("read_ids"))
    return reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"), *aggs)


def bismark_positions(calls: DataFrame, min_coverage: int = 1, min_meth: float = 0.0) -> DataFrame:
    """Call rows (state +/-, letter) to a methylation track; state and letter case must agree."""
    upper = F.col("letter").isin("Z", "X", "H")
    lower = F.col("letter").isin("z", "x", "h")
    valid = ((F.col("state") == "+") & upper) | ((F.col("state") == "-") & lower)
    return (
        calls.filter(valid).groupBy("chrom", "pos")
        .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("state") == "+").cast("bigint")).alias("n_meth"))
        .filter(F.col("n") >= min_coverage)
        .select("chrom", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"),
                (F.col("n_meth") / F.col("n")).alias("meth"))
        .filter(F.col("meth") >= min_meth)
    )
