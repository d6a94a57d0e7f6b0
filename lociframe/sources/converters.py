"""Row formats of other tools to the library's tables and back."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def peaks_to_features(df: DataFrame, source: str, summit: str | None = None, half: int = 0) -> DataFrame:
    """Peak rows (0-based, half open) to 1-based features; around the summit when given."""
    lo, hi = F.col("s") + 1, F.col("e")
    if summit:
        lo, hi = F.col("s") + F.col(summit) - half + 1, F.col("s") + F.col(summit) + half + 1
    return df.select("chrom", F.lit(source).alias("source"), lo.alias("start_pos"), hi.alias("end_pos"), "score", F.lit(".").alias("strand"))


def psl_to_features(df: DataFrame) -> DataFrame:
    """PSL rows (t_name, t_start, t_end, strand, q_name, match) to features."""
    return df.select(F.col("t_name").alias("chrom"), (F.col("t_start") + 1).alias("start_pos"), F.col("t_end").alias("end_pos"), "strand",
                     F.col("q_name").alias("name"), F.col("match").alias("score"))


def psl_insertions(df: DataFrame, min_len: int = 1) -> DataFrame:
    """Gaps in the query between consecutive aligned blocks: comma lists q_starts, block_sizes."""
    qs, bs = F.split(F.rtrim(F.col("q_starts"), F.lit(",")), ","), F.split(F.rtrim(F.col("block_sizes"), F.lit(",")), ",")
    i = F.when(F.size(qs) > 1, F.sequence(F.lit(0), F.size(qs) - 2)).otherwise(F.array().cast("array<int>"))
    rows = df.select("q_name", qs.alias("q"), bs.alias("b"), F.explode(i).alias("i"))
    end = F.get("q", F.col("i")).cast("int") + F.get("b", F.col("i")).cast("int")
    gap = F.get("q", F.col("i") + 1).cast("int") - end
    return rows.select("q_name", end.alias("ins_start"), gap.alias("ins_len")).filter(F.col("ins_len") >= min_len)


def gff_to_cse(df: DataFrame) -> DataFrame:
    """chromosome number, start, end rows."""
    return df.select(F.concat_ws(",", F.regexp_replace("chrom", "^chr", ""), F.col("start_pos").cast("string"), F.col("end_pos").cast("string")).alias("line"))


def cse_to_features(df: DataFrame, source: str) -> DataFrame:
    p = F.split("line", ",")
    return df.select(F.concat(F.lit("chr"), p[0]).alias("chrom"), F.lit(source).alias("source"), p[1].cast("int").alias("start_pos"), p[2].cast("int").alias("end_pos"))


def features_to_probe_regions(df: DataFrame) -> Column:
    return F.concat(F.col("chrom"), F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"))


def count_table_to_cytosines(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Protocol count rows to cytosines: minus-strand positions shift by one, copies add up."""
    pos = F.col("pos") + F.when(F.col("strand") == "-", 1).otherwise(0)
    return df.groupBy("chrom", pos.alias("chrom_pos"), "strand").agg(*[F.sum(c).alias(c) for c in counts])


def array_matrix(values: DataFrame, probes: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Scanner values (sample, x, y, value) placed on probes (x, y, probe, chrom, pos): one column per sample."""
    j = values.join(probes, ["x", "y"])
    return j.groupBy("probe", "chrom", "pos").agg(*[F.avg(F.when(F.col("sample") == s, F.col("value"))).alias(s) for s in samples])


def vcf_lines(calls: DataFrame, min_qual: float = 30.0) -> DataFrame:
    """Variant rows (chrom, pos, ref, alt, qual, depth, genotype) as VCF text with its header.

    FILTER is PASS from `min_qual` up, else LowQual. Header lines have a null chrom and negative
    positions, so they come first by (chrom nulls first, pos).
    """
    head = [
        "##fileformat=VCFv4.1", f'##FILTER=<ID=LowQual,Description="Quality below {min_qual:g}">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE",
    ]
    top = calls.sparkSession.createDataFrame([(None, i - len(head), h) for i, h in enumerate(head)], "chrom string, pos bigint, line string")
    body = calls.select("chrom", F.col("pos").cast("bigint").alias("pos"), F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.coalesce("alt", F.lit(".")), F.format_string("%.2f", F.col("qual")),
        F.when(F.col("qual") >= min_qual, "PASS").otherwise("LowQual"), F.format_string("DP=%d", F.col("depth")), F.lit("GT"), "genotype").alias("line"))
    return top.unionByName(body)


def matrix_rows(cells: DataFrame, row: str, col: str, value: str, columns: int) -> DataFrame:
    """Long cells to one text row per matrix row, `columns` wide, missing cells empty."""
    g = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col), F.col(value)))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.coalesce(F.try_element_at("m", i).cast("string"), F.lit(""))), ",")
    return g.select(row, line.alias("line"))


def with_attribute(attrs: Column, key: str, value: Column) -> Column:
    """Attribute map with one key set."""
    kept = F.map_filter(attrs, lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), F.array(value)))


def without_attributes(attrs: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(attrs, lambda k, _: ~k.isin(list(keys)))


def browser_link(chrom: Column, start: Column, end: Column, base: str, flank: int = 0) -> Column:
    return F.format_string(base + "position=%s:%d-%d", chrom, start - flank, end + flank)


def remap_ids(df: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """Ids replaced by the table (old_id, new_id); unknown ones stay."""
    t = table.select(F.col("old_id").alias(id_col), "new_id")
    return df.join(t, id_col, "left").withColumn(id_col, F.coalesce("new_id", id_col)).drop("new_id")


def fastq_lines(df: DataFrame) -> Column:
    return F.concat(F.lit("@"), "read_name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")


def fasta_lines(df: DataFrame, name: str = "seq_name") -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), "seq")


def qseq_to_fastq(df: DataFrame) -> DataFrame:
    """Tab-separated instrument rows (11 fields) to reads; dots become N."""
    p = F.split("value", "\t")
    name = F.concat_ws(":", p[0], p[2], p[3], p[4], p[5])
    return df.select(name.alias("read_name"), F.translate(p[8], ".", "N").alias("seq"), p[9].alias("qual"), (p[10] == "1").alias("passed"))


def reference_string(seq: Column, cigar: Column, md: Column) -> tuple[Column, Column]:
    """(aligned read, reference) of an alignment from its CIGAR and MD tag; gaps as `-`.

    CIGAR and MD are walked together per read, a batch of reads at a time.
    """
    @F.pandas_udf("struct<read: string, ref: string>")
    def walk(s: pd.Series, c: pd.Series, m: pd.Series) -> pd.DataFrame:
        import re

        out = []
        for seq_, cig, md_ in zip(s, c, m):
            if seq_ is None or cig is None or md_ is None:
                out.append((None, None))
                continue
            read, is_base, at = [], [], 0
            for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cig):
                n = int(n)
                if op in "M=X":
                    read.extend(seq_[at:at + n]); is_base.extend("M" * n); at += n
                elif op == "I":
                    read.extend(seq_[at:at + n]); is_base.extend("I" * n); at += n
                elif op in "DN":
                    read.extend("-" * n); is_base.extend("D" * n)
                elif op == "S":
                    at += n
            marks = []
            for run, gone, sub in re.findall(r"(\d+)|\^([A-Z]+)|([A-Z])", md_):
                marks.extend([None] * int(run) if run else list(gone or sub))
            it, ref = iter(marks), []
            for base, kind in zip(read, is_base):
                mark = None if kind == "I" else next(it, None)
                ref.append("-" if kind == "I" else (mark or base))
            out.append(("".join(read), "".join(ref)))
        return pd.DataFrame(out, columns=["read", "ref"])

    both = walk(seq, cigar, md)
    return both["read"], both["ref"]


