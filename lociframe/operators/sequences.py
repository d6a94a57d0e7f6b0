"""Work on nucleotide sequences, cut into overlapping pieces so long ones spread over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions.sequence import iupac_regex, iupac_revcomp, revcomp
from lociframe.operators.tiles import position_halo, tile_window

PIECE = 512


def pieces(seqs: DataFrame, overlap: int = 0, size: int = PIECE, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """keys, `offset` (0-based) and `piece`; neighbours share `overlap` bases at the right."""
    k = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / size).cast("int")))
    rows = seqs.filter(F.length("seq") > 0).select(*keys, "seq", k.alias("k"))
    return rows.select(*keys, (F.col("k") * size).alias("offset"), F.substring(F.col("seq"), F.col("k") * size + 1, F.lit(size + overlap)).alias("piece"))


def starts(df: DataFrame, n: int, size: int = PIECE) -> DataFrame:
    """One row per start of an n-long word: 1-based `pos` in the sequence and `word`."""
    last = F.least(F.lit(size), F.length("piece") - (n - 1))
    idx = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("_i", F.explode(idx))
    return rows.select(*[c for c in df.columns if c not in ("piece", "offset")], (F.col("offset") + F.col("_i")).alias("pos"),
                       F.substring(F.col("piece"), F.col("_i"), F.lit(n)).alias("word"))


def words(seqs: DataFrame, n: int, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    return starts(pieces(seqs, n - 1, keys=keys), n)


def nmer_counts(seqs: DataFrame, n: int, start: int = 0, both_strands: bool = False, all_permutations: bool = False) -> DataFrame:
    """Counts of n-long words without N; `start` > 0 looks at that position only."""
    src = seqs.select("seq_id", F.upper("seq").alias("seq"))
    if start > 0:
        word = F.substring(F.col("seq"), F.lit(start), F.lit(n))
        rows = src.filter(F.length("seq") >= start + n - 1).select(word.alias("word"))
    else:
        rows = words(src, n).select("word")
    if both_strands:
        rows = rows.select(F.explode(F.array("word", revcomp(F.col("word")))).alias("word"))
    counts = rows.filter(~F.col("word").contains("N")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if not all_permutations:
        return counts
    letters = F.array(*map(F.lit, "ACGT"))
    grid = seqs.sparkSession.range(1).select(F.lit("").alias("word"))
    for _ in range(n):
        grid = grid.select("word", F.explode(letters).alias("_l")).select(F.concat("word", "_l").alias("word"))
    return grid.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def nmer_enrichment(seqs: DataFrame, n: int) -> DataFrame:
    """Share of each word against the product of its base frequencies.

    The base frequencies are one aggregate row with four columns.
    """
    counts = nmer_counts(seqs, n)
    total = counts.agg(F.sum("n")).scalar()
    up = F.upper("seq")
    tally = seqs.agg(*[F.sum(F.length(up) - F.length(F.replace(up, F.lit(b), F.lit("")))).alias(b) for b in "ACGT"])
    shares = tally.select(F.struct(*[(F.col(b) / sum(F.col(x) for x in "ACGT")).alias(b) for b in "ACGT"])).scalar()
    out = counts.withColumns({"share": F.col("n") / total, "_f": shares})
    expected = F.lit(1.0)
    for i in range(1, n + 1):
        c = F.substring(F.col("word"), i, 1)
        expected = expected * (F.when(c == "A", F.col("_f.A")).when(c == "C", F.col("_f.C")).when(c == "G", F.col("_f.G")).otherwise(F.col("_f.T")))
    return out.select("word", "n", "share", expected.alias("expected"), (F.col("share") / expected).alias("enrichment"))


def nmer_windows(seqs: DataFrame, n: int, window: int) -> DataFrame:
    w = words(seqs, n)
    return w.groupBy("seq_id", (F.floor((F.col("pos") - 1) / window) * window + 1).cast("bigint").alias("window"), "word").agg(F.count(F.lit(1)).alias("n"))


def motif_positions(seqs: DataFrame, pattern: str, both_strands: bool = True) -> DataFrame:
    """Starts (leftmost base) of an ambiguity pattern on either strand."""
    n = len(pattern)
    w = words(seqs, n)
    fw = w.filter(F.col("word").rlike(f"^{iupac_regex(pattern)}$")).select("seq_id", "pos", F.lit("+").alias("strand"))
    if not both_strands:
        return fw
    marks = F.filter(F.array(
        F.when(F.col("word").rlike(f"^{iupac_regex(pattern)}$"), "+"),
        F.when(F.col("word").rlike(f"^{iupac_regex(iupac_revcomp(pattern))}$"), "-")), lambda x: x.isNotNull())
    return w.select("seq_id", "pos", F.explode(marks).alias("strand"))


def cpg_coords(seqs: DataFrame) -> DataFrame:
    return words(seqs.select("seq_id", F.upper("seq").alias("seq")), 2).filter(F.col("word") == "CG").select("seq_id", "pos")


def literal_starts(pieces: DataFrame, word: str, size: int, seq: str = "seq", offset: str = "offset") -> DataFrame:
    """Add `pos` (1-based in the sequence): starts of a literal word in the first `size` bases of each piece.

    One pass over a piece: the word's places follow from the lengths between its occurrences, so it
    must not overlap itself.
    """
    if any(word.startswith(word[-k:]) for k in range(1, len(word))):
        raise ValueError(f"{word} overlaps itself")
    n = len(word)
    gaps = F.transform(F.split(F.upper(seq), word), lambda x: F.length(x))
    step = lambda acc, gap: F.struct((acc["at"] + gap + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + gap + 1)).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    found = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), zero, step)["out"]
    rows = pieces.withColumn("_at", F.explode(found)).filter(F.col("_at") <= size)
    return rows.withColumn("pos", F.col(offset) + F.col("_at")).drop("_at")


def matches(seq: Column, regex: str) -> Column:
    """array<struct<pos, text>> of the non-overlapping matches, left to right (1-based)."""
    parts = F.split(F.regexp_replace(seq, f"({regex})", "<$1>"), "<")
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p) - F.when(p.contains(">"), 1).otherwise(0)).alias("at"),
        F.when(p.contains(">"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("pos"), F.substring_index(p, ">", 1).alias("text"))))).otherwise(acc["out"]).alias("out"))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<pos:int,text:string>>").alias("out"))
    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def oligo_runs(seqs: DataFrame, oligo: str, min_copies: int) -> DataFrame:
    """Tandem copies of an oligo on both strands: leftmost 0-based position and number of copies.

    Minus runs are looked for on the reverse complement and reported in plus coordinates.
    """
    up = F.upper("seq")
    hit = lambda s: F.filter(matches(s, f"(?:{oligo})+"), lambda m: F.length(m["text"]) >= min_copies * len(oligo))
    both = seqs.select("seq_id", F.length("seq").alias("len"), F.explode(F.array(
        F.struct(F.lit("+").alias("strand"), hit(up).alias("m")), F.struct(F.lit("-").alias("strand"), hit(revcomp(up)).alias("m")))).alias("x"))
    rows = both.select("seq_id", "len", "x.strand", F.explode("x.m").alias("m"))
    size = F.length("m.text")
    pos = F.when(F.col("strand") == "+", F.col("m.pos") - 1).otherwise(F.col("len") - (F.col("m.pos") - 1) - size)
    return rows.select("seq_id", "strand", pos.alias("pos"), (size / len(oligo)).cast("int").alias("copies"))


def homopolymers(seqs: DataFrame, n: int, base: str = "A", other: str = "T") -> DataFrame:
    """Non-overlapping stretches of exactly `n` equal bases (base on plus, its partner on minus)."""
    rows = seqs.select("seq_id", F.explode(matches(F.upper("seq"), f"{base}{{{n}}}|{other}{{{n}}}")).alias("m"))
    return rows.select("seq_id", F.col("m.pos").alias("pos"), F.when(F.col("m.text").startswith(base), "+").otherwise("-").alias("strand"))


def pattern_position_counts(reads: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """How often each pattern starts at each read position."""
    out = None
    for p in patterns:
        w = words(reads, len(p)).filter(F.col("word").rlike(f"^{iupac_regex(p)}$"))
        g = w.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).withColumn("pattern", F.lit(p))
        out = g if out is None else out.unionByName(g)
    return out


def base_density(seqs: DataFrame, window: int, kind: str = "cpg", step: int = 1) -> DataFrame:
    """Sliding CpG observed/expected or GC share; `pos` is the 0-based window middle (>= 1).

    Around middle m the window holds bases m-h+1 .. m-h+window+1 with h = window/2; sums are
    differences of growing frames inside tiles of one sequence.
    """
    h = (window + 1) // 2
    lo, hi = -(h - 1), window + 1 - h
    b = words(seqs.select("seq_id", F.upper("seq").alias("seq")), 1).select("seq_id", (F.col("pos") - 1).alias("p"), F.col("word").alias("b"))
    rows = position_halo(b, "p", h + 1, hi + 1)
    w = tile_window(["seq_id"], "p")
    upto, before = w.rangeBetween(Window.unboundedPreceding, hi), w.rangeBetween(Window.unboundedPreceding, lo - 1)
    tally = lambda c: F.sum(c).over(upto) - F.coalesce(F.sum(c).over(before), F.lit(0))
    one = lambda ch: F.when(F.col("b") == ch, 1).otherwise(0)
    rows = rows.withColumns({"_c": one("C"), "_g": one("G"), "_cg": F.when((F.col("b") == "G") & (F.lag("b").over(w) == "C"), 1).otherwise(0)})
    # a CG pair counts when its G lies in the window and its C does too
    pairs = F.sum("_cg").over(upto) - F.coalesce(F.sum("_cg").over(w.rangeBetween(Window.unboundedPreceding, lo)), F.lit(0))
    out = rows.select("seq_id", "p", "_home", tally("_c").alias("c"), tally("_g").alias("g"), pairs.alias("cg"),
                      F.max("p").over(w.rangeBetween(hi, hi)).alias("last"))
    out = out.filter(F.col("_home") & (F.col("p") >= 1) & F.col("last").isNotNull() & (F.col("p") % step == 0))
    if kind == "gc":
        value = (F.col("c") + F.col("g")) / window
    else:
        value = F.coalesce(F.col("cg") * window / F.nullif(F.col("c") * F.col("g"), F.lit(0)), F.lit(0.0))
    return out.select("seq_id", F.col("p").alias("pos"), value.alias("value"))


