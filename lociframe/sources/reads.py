"""Read-level inputs: pileup, SAM text, FASTQ, FASTA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.functions.sequence import quality
from lociframe.operators.tiles import running

FASTA_PIECE = 1 << 14
PILEUP_SCHEMA = ("chrom string, pos int, ref string, depth int, bases string, quals string, "
                 "mapquals string, cycles string")


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=PILEUP_SCHEMA, quote="", escape="")


def explode_pileup(df: DataFrame, min_quality: int = 0, only_first_cycle: bool = False) -> DataFrame:
    """One row per read base. `bases` and `quals` lead with @; `,` `.` repeat the reference
    on + and -, letters carry their strand in their case."""
    chars = lambda c: F.split(F.substring(c, 2, 1 << 30), "")
    zipped = F.arrays_zip(chars("bases").alias("b"), chars("quals").alias("q"),
                          F.split(F.rtrim(F.col("cycles"), F.lit(",")), ",").alias("c"))
    rows = df.filter(F.col("depth") > 0).select("chrom", "pos", F.upper("ref").alias("ref"), F.posexplode(zipped).alias("i", "x"))
    b = F.col("x.b")
    strand = F.when(b == ",", "+").when(b == ".", "-").when(b.rlike("[A-Z]"), "+").otherwise("-")
    out = rows.select(
        "chrom", "pos", "ref", (F.col("i") + 1).alias("read_index"), strand.alias("strand"),
        F.when(b.isin(",", "."), F.col("ref")).otherwise(F.upper(b)).alias("base"),
        quality(F.col("x.q")).alias("qual"), F.col("x.c").try_cast("int").alias("cycle"))
    out = out.filter(F.col("qual") >= min_quality)
    return out.filter(F.col("cycle") == 1) if only_first_cycle else out


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text (headers skipped) with the MD tag and decoded flag bits."""
    raw = spark.read.text(path).filter(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    df = raw.filter(F.size(f) >= 11).select(
        f[0].alias("read_name"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), f[3].cast("int").alias("start_pos"),
        f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[7].cast("int").alias("mate_pos"),
        f[9].alias("seq"), f[10].alias("qual"),
        F.nullif(F.regexp_extract("value", r"\tMD:Z:(\S+)", 1), F.lit("")).alias("md"))
    return with_flags(df)


def with_flags(df: DataFrame) -> DataFrame:
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    return df.withColumns({
        "paired": bit(1), "proper_pair": bit(2), "unmapped": bit(4), "mate_reverse": bit(32),
        "second_of_pair": bit(128), "not_primary": bit(256), "duplicate": bit(1024),
        "strand": F.when(bit(16), "-").otherwise("+")})


def usable(min_mapq: int = 0, allow_bad_mates: bool = False, remove_dups: bool = False) -> Column:
    """Alignment filter: mapped, primary, properly paired; of same-start mates only the first counts."""
    inverted = F.col("paired") & (F.col("start_pos") == F.col("mate_pos")) & (
        (F.col("strand") == "-") == F.col("mate_reverse")) & F.col("second_of_pair")
    ok = ~F.col("unmapped") & (F.col("mapq") >= min_mapq) & ~F.col("not_primary") & ~inverted
    if not allow_bad_mates:
        ok = ok & (~F.col("paired") | F.col("proper_pair"))
    return ok & ~F.col("duplicate") if remove_dups else ok


def first_at_start(df: DataFrame) -> DataFrame:
    """Of unpaired reads with one alignment start keep a single one (lowest name)."""
    lone = df.filter(~F.col("paired"))
    keep = lone.groupBy("chrom", "start_pos").agg(F.min_by(F.struct(*df.columns), "read_name").alias("r")).select("r.*")
    return df.filter(F.col("paired")).unionByName(keep)


def number_lines(spark: SparkSession, path: str | list[str], keep: Column | None = None) -> DataFrame:
    """Text lines (those that `keep` wants) with their 0-based number per file, also when a file is read in several splits.

    Lines of one split are consecutive in `monotonically_increasing_id`; the splits of a file
    (few rows) are put in order by their byte offset and give each other their line counts.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if keep is not None:
        raw = raw.filter(keep)
    raw = raw.withColumn("id", F.monotonically_increasing_id())
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("skip", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    out = raw.join(blocks, ["file", "block"])
    return out.select("file", (F.col("id") - F.col("first") + F.col("skip")).alias("line"), "value")


def carry_header(lines: DataFrame, header: Column, name: str = "header") -> DataFrame:
    """Add to every line the last header at or above it in its file; `header` is a struct that begins with the line, or null.

    Headers travel from tile to tile of the line numbers as one carry row, so a file with a single
    header is worked on by as many tasks as it has tiles.
    """
    return running(lines.withColumn("_header", header), ["file"], "line", maxes={name: F.col("_header")}).drop("_header")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Four-line FASTQ records."""
    lines = number_lines(spark, path)
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    recs = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(
        part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    return recs.filter(F.col("head").startswith("@")).select(
        F.regexp_extract("head", r"^@(\S+)", 1).alias("read_name"), "seq", "qual")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per sequence: name (first word of the header) and bases without line breaks."""
    raw = spark.read.text(path, lineSep=">").filter(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s+", "")
    return raw.select(F.regexp_extract(head, r"^(\S+)", 1).alias("seq_name"), body.alias("seq"))


def read_fasta_pieces(spark: SparkSession, path: str | list[str], halo: int = 0, size: int = FASTA_PIECE) -> DataFrame:
    """Sequences in pieces: file, record (line of the header), seq_name, offset (0-based) and seq.

    A piece has `size` bases of its own and `halo` more of the next ones, so words of halo + 1 bases
    that start in it are whole. The offset of a line is a running sum of lengths, so neither a
    sequence nor a file becomes a row.
    """
    is_head = F.startswith(F.col("value"), F.lit(">"))
    lines = number_lines(spark, path, F.trim("value") != "")
    lines = lines.withColumn("bases", F.when(is_head, "").otherwise(F.regexp_replace("value", r"\s", "")))
    lines = running(lines, ["file"], "line", sums={"upto": F.length("bases").cast("bigint")})
    lines = carry_header(lines, F.when(is_head, F.struct("line", "upto", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("name"))))
    n = F.length("bases")
    rows = lines.filter(F.col("header").isNotNull() & (n > 0)).select(
        "file", F.col("header.line").alias("record"), F.col("header.name").alias("seq_name"), (F.col("upto") - n - F.col("header.upto")).alias("at"), n.alias("n"), "bases")
    first, last = F.floor(F.greatest(F.col("at") - halo, F.lit(0)) / size), F.floor((F.col("at") + F.col("n") - 1) / size)
    rows = rows.withColumn("offset", F.explode(F.transform(F.sequence(first.cast("bigint"), last.cast("bigint")), lambda k: k * size)))
    begin, end = F.greatest("at", "offset"), F.least(F.col("at") + F.col("n"), F.col("offset") + size + halo)
    part = F.struct(begin.alias("p"), F.substring("bases", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("b"))
    parts = rows.filter(end > begin).groupBy("file", "record", "seq_name", "offset").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select("file", "record", "seq_name", "offset", F.array_join(F.transform("parts", lambda x: x["b"]), "").alias("seq"))


def fasta_lines(seqs: DataFrame, name: Column, seq: Column, width: int = 60) -> DataFrame:
    """Columns record, ord and value: a header and lines of `width` bases for each sequence (write with `write_records`)."""
    rows = seqs.select(name.cast("string").alias("record"), seq.alias("seq"))
    starts = F.when(F.length("seq") > 0, F.sequence(F.lit(1), F.length("seq"), F.lit(width))).otherwise(F.array().cast("array<int>"))
    lines = F.concat(F.array(F.concat(F.lit(">"), "record")), F.transform(starts, lambda i: F.substring("seq", i, F.lit(width))))
    return rows.select("record", F.posexplode(lines).alias("ord", "value"))


def write_records(lines: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """`value` lines in order; the lines of one key stay together in one file."""
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys, *order).select("value").write.text(path)
