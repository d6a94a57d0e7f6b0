"""Interval and track text formats: BED, WIG (fixed/variable step), GFF/GTF, tagAlign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import intervals as I
from lociframe.functions import methylation as M
from lociframe.operators.tiles import tile_of, tile_window
from lociframe.sources.reads import carry_header, number_lines, write_records


def display_chrom(chrom: Column) -> Column:
    out = chrom
    for c in "xym":
        out = F.regexp_replace(out, f"chr{c}", f"chr{c.upper()}")
    return out


def bed_line(chrom: Column, start: Column, end: Column, strand: Column, meth: Column) -> Column:
    """Nine-column BED line, score in percent, colour by methylation."""
    score = F.coalesce(F.floor(F.lit(100.0) * meth + 0.5).cast("bigint"), F.lit(0).cast("bigint"))
    return F.concat_ws(
        "\t", display_chrom(chrom), start.cast("string"), end.cast("string"),
        F.concat(F.lit("r"), start.cast("string"), strand), score.cast("string"), strand,
        start.cast("string"), end.cast("string"), M.meth_colour(meth))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED (0-based, half open) to closed 1-based features."""
    schema = "chrom string, s int, e int, name string, score double, strand string"
    raw = spark.read.csv(path, sep="\t", schema=schema, comment="#")
    raw = raw.filter(F.col("s").isNotNull())  # track and browser lines
    return raw.select("chrom", (F.col("s") + 1).alias("start_pos"), F.col("e").alias("end_pos"),
                      F.coalesce("strand", F.lit(".")).alias("strand"), "score", "name")


def write_bed(features: DataFrame, path: str) -> None:
    lines = features.select("chrom", (F.col("start_pos") - 1).alias("s"), "end_pos", "name", "score", "strand")
    lines.repartitionByRange("chrom", "s").sortWithinPartitions("chrom", "s").write.mode("overwrite").csv(path, sep="\t")


def gff_attributes(text: Column) -> Column:
    """`key "value"; key "value"` or `key=value;...` to map<string, array<string>>."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(
        F.regexp_extract(p, r"^([^\s=]+)", 1).alias("k"),
        F.regexp_replace(F.regexp_extract(p, r"^[^\s=]+[\s=]+(.*)$", 1), '"', "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(
        k, F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))))


def gff_attribute_text(attrs: Column) -> Column:
    each = F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.array_join(F.transform(
        e["value"], lambda v: F.concat(e["key"], F.lit(' "'), v, F.lit('"'))), "; "))
    return F.concat(F.array_join(each, "; "), F.lit(";"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    schema = ("chrom string, source string, feature string, start_pos int, end_pos int, "
              "score string, strand string, frame string, att string")
    raw = spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="")
    return raw.filter(F.col("start_pos").isNotNull()).select(
        "chrom", "source", "feature", "start_pos", "end_pos", F.col("score").try_cast("double").alias("score"),
        "strand", "frame", gff_attributes(F.col("att")).alias("attributes"))


def gff_line(df_attr: str = "attributes") -> Column:
    dot = F.lit(".")
    return F.concat_ws("\t", "chrom", "source", "feature", F.col("start_pos").cast("string"),
                       F.col("end_pos").cast("string"), F.coalesce(F.col("score").cast("string"), dot),
                       F.coalesce("strand", dot), F.coalesce("frame", dot), gff_attribute_text(F.col(df_attr)))


def write_text_by_chrom(lines: DataFrame, path: str, order: list[str]) -> None:
    """`chrom`, ordering columns and `value`: ordered text, range-partitioned inside chromosomes."""
    (lines.repartitionByRange("chrom", *order).sortWithinPartitions("chrom", *order)
          .select("chrom", "value").write.mode("overwrite").partitionBy("chrom").text(path))


def variable_step_lines(df: DataFrame, pos: str, value: Column) -> DataFrame:
    """WIG lines, header first: columns chrom, ord, value (write with `write_text_by_chrom`)."""
    head = df.select("chrom").distinct().select(
        "chrom", F.lit(-1).cast("bigint").alias("ord"), F.concat(F.lit("variableStep chrom="), "chrom").alias("value"))
    body = df.select("chrom", F.col(pos).cast("bigint").alias("ord"),
                     F.concat_ws("\t", F.col(pos).cast("string"), value.cast("string")).alias("value"))
    return head.unionByName(body)


def bedgraph_lines(df: DataFrame, start: str, end: str, value: Column) -> DataFrame:
    return df.select("chrom", F.col(start).cast("bigint").alias("ord"), F.concat_ws(
        "\t", "chrom", (F.col(start) - 1).cast("string"), F.col(end).cast("string"), value.cast("string")).alias("value"))


WIG_DATA = r"^\s*-?[0-9.]"


def read_wig(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """fixedStep / variableStep text to (chrom, pos, value, span).

    A value belongs to the last header above it, which is carried over tiles of the numbers that
    headers and values have in their file (track, browser and comment lines are not counted); a fixed
    step's position follows from the distance to its header. A large file is read in many splits
    and none of its blocks becomes a row. Values above the first header of a file are left out.
    """
    word = F.regexp_extract("value", r"^\s*(fixedStep|variableStep)\s", 1)
    lines = number_lines(spark, path, (word != "") | F.col("value").rlike(WIG_DATA))
    field = lambda k, d: F.coalesce(F.nullif(F.regexp_extract("value", rf"\b{k}=(\S+)", 1), F.lit("")), F.lit(d))
    head = F.struct("line", (word == "fixedStep").alias("fixed"), field("chrom", "").alias("chrom"), *[field(k, "1").cast("bigint").alias(k) for k in ("start", "step", "span")])
    rows = carry_header(lines, F.when(word != "", head)).filter(F.col("header").isNotNull() & (word == ""))
    parts = F.split(F.trim("value"), r"\s+")
    h = lambda k: F.col(f"header.{k}")
    return rows.select(
        h("chrom").alias("chrom"), F.when(h("fixed"), h("start") + h("step") * (F.col("line") - h("line") - 1)).otherwise(parts[0].cast("bigint")).alias("pos"),
        F.when(h("fixed"), parts[0]).otherwise(F.get(parts, F.lit(1))).cast("double").alias("value"), h("span").cast("int").alias("span"))


def wig_lines(df: DataFrame, pos: str, value: Column, step: int | None = None, span: int = 1) -> DataFrame:
    """WIG lines as columns chrom, tile, ord and value (write with `write_wig`).

    variableStep, or fixedStep blocks of positions that are `step` apart. Headers repeat at the
    start of each tile, so every file of a distributed write begins with one.
    """
    tiled = df.select("chrom", F.col(pos).cast("bigint").alias("pos"), value.cast("string").alias("v"), tile_of(pos).alias("_tile"))
    ahead = F.lag("pos").over(tile_window(["chrom"], "pos"))
    if step:
        fresh = ahead.isNull() | (F.col("pos") - ahead != step)
        head = F.concat(F.lit("fixedStep chrom="), "chrom", F.lit(" start="), F.col("pos").cast("string"), F.lit(f" step={step} span={span}"))
        line = F.col("v")
    else:
        fresh, head = ahead.isNull(), F.concat(F.lit("variableStep chrom="), "chrom", F.lit(f" span={span}"))
        line = F.concat_ws("\t", F.col("pos").cast("string"), "v")
    each = lambda k, text: F.struct((F.col("pos") * 2 + k).alias("ord"), text.alias("value"))
    lines = F.when(fresh, F.array(each(0, head), each(1, line))).otherwise(F.array(each(1, line)))
    return tiled.withColumn("_lines", lines).select("chrom", F.col("_tile").alias("tile"), F.inline("_lines"))


def write_wig(lines: DataFrame, path: str) -> None:
    """Text files of whole tiles, each of which can be read on its own."""
    write_records(lines, path, ["chrom", "tile"], ["ord"])


def tag_align(df: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Alignment rows to tagAlign: closed span of the read, sequence, quality, strand."""
    return df.filter(F.col("mapq") >= min_mapq).select(
        "chrom", "start_pos", (F.col("start_pos") + F.length("seq") - 1).alias("end_pos"), "seq", "mapq", "strand")


def tag_starts(df: DataFrame) -> DataFrame:
    """Strand-aware 5' start of each tag, one row per (chrom, start, strand)."""
    start = F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos"))
    return df.filter(F.col("strand").isin("+", "-", ".")).select("chrom", start.alias("read_start"), "strand").distinct()


def exon_rows(genes: DataFrame, starts: str, ends: str, n: str = "n_exons") -> DataFrame:
    """One row per exon of comma-joined start and end lists."""
    pairs = F.slice(F.arrays_zip(F.split(starts, ",").alias("s"), F.split(ends, ",").alias("e")), F.lit(1), F.col(n))
    keep = [c for c in genes.columns if c not in (starts, ends, n)]
    return genes.select(*keep, F.explode(pairs).alias("x")).select(
        *keep, F.col("x.s").cast("bigint").alias("start_pos"), F.col("x.e").cast("bigint").alias("end_pos"))


def feature_points(features: DataFrame, use_midpoint: bool = False, short: int = 10) -> DataFrame:
    """Features to a point table: starts, ends, midpoints; short features give one point."""
    s, e, strand = F.col("start_pos"), F.col("end_pos"), F.col("strand")
    rev, length = strand == "-", I.span(F.col("start_pos"), F.col("end_pos"))
    pt = lambda p, label, st: F.struct(p.alias("point"), F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), st.alias("point_strand"))
    if use_midpoint:
        points = F.array(pt(F.floor((s + e + 1) / 2).cast("int"), "Midpoint", strand))
    else:
        one = F.array(pt(F.when(rev, e).otherwise(s), "Starts", strand))
        bare = F.array(pt(s, "Unstranded", F.lit("+")), pt(e, "Unstranded", F.lit("-")))
        both = F.array(pt(s, F.when(rev, "Ends").otherwise("Starts"), F.lit("+")),
                       pt(e, F.when(rev, "Starts").otherwise("Ends"), F.lit("-")))
        points = F.when(length <= short, one).when(strand == ".", bare).otherwise(both)
    return features.select("feat_type", "chrom", length.cast("bigint").alias("feat_len"), F.explode(points).alias("p")).select(
        "feat_type", "chrom", "feat_len", "p.*")
