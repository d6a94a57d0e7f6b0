"""Filters and projections that need more than one column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.piles import beside_name
from lociframe.operators.tiles import position_halo, tile_window
from lociframe.functions.sequence import hamming, quality


def cap_identical(df: DataFrame, keys: Sequence[str], limit: int, order: str) -> DataFrame:
    """Keep at most `limit` rows per key, lowest `order` first.

    Only the survivors are gathered: rank within a salted part, then across the parts.
    """
    salt = F.pmod(F.xxhash64(order), F.lit(64))
    part = Window.partitionBy(*keys, "_salt").orderBy(order)
    near = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= limit)
    whole = Window.partitionBy(*keys).orderBy(order)
    return near.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= limit).drop("_salt", "_r")


def min_depth(bases: DataFrame, total: int = 0, each_strand: int = 0) -> DataFrame:
    """Positions with enough reads, in all or on each strand."""
    fw = F.sum((F.col("strand") == "+").cast("bigint"))
    rv = F.sum((F.col("strand") == "-").cast("bigint"))
    d = bases.groupBy("chrom", "pos").agg(fw.alias("depth_fw"), rv.alias("depth_rev"))
    ok = F.col("depth_fw") + F.col("depth_rev") >= total
    return d.filter(ok & (F.col("depth_fw") >= each_strand) & (F.col("depth_rev") >= each_strand))


def base_neighbours(refs: DataFrame, before: int, after: int, pos: str = "pos", base: str = "ref_base") -> DataFrame:
    """Reference base around each position; NULL at gaps in the covered positions and chromosome ends.

    Rows dealt by `piles.tiled_bases` have the neighbours of their tile with them and stay where they are. Rows
    that already name their neighbours (`piles.base_sums`) are only reduced to those of their own tile.
    """
    dealt = "tile" in refs.columns
    names = [beside_name(k, base) for k in range(-before, after + 1) if k]
    if dealt and set(names) <= set(refs.columns):
        own = refs.filter(F.col("tile").isNotNull() & F.col("home"))
        return own.select(*[c for c in refs.columns if c not in ("tile", "home", *names)], *names)
    out = refs.filter(F.col("tile").isNotNull()).withColumnsRenamed({"tile": "_tile", "home": "_home"}) if dealt else position_halo(refs, pos, before, after)
    w = tile_window(["chrom"], pos)
    for k in [*range(-before, 0), *range(1, after + 1)]:
        at = w.rangeBetween(k, k)
        out = out.withColumn(beside_name(k, base), F.max(base).over(at))
    return out.filter("_home").drop("_home", "_tile")


def global_coordinates(sizes: DataFrame, order: str = "chrom") -> DataFrame:
    """Chromosome sizes with the offset of each chromosome in one concatenated coordinate.

    One row per chromosome: the size list is bounded by the genome, not by the data.
    """
    ahead = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))


def to_global(df: DataFrame, sizes: DataFrame, pos: str) -> DataFrame:
    return df.join(global_coordinates(sizes).select("chrom", "offset"), "chrom").withColumn(
        "global_pos", F.col("offset") + F.col(pos)).drop("offset")


def to_local(df: DataFrame, sizes: DataFrame, global_pos: str = "global_pos") -> DataFrame:
    """Back from the global coordinate: the chromosome whose stretch holds it."""
    g = global_coordinates(sizes).select("chrom", "offset", "length")
    stretches = F.array_sort(F.collect_list(F.struct("offset", "length", "chrom")))
    out = df.withColumn("_g", g.agg(stretches).scalar())  # one entry per chromosome
    hit = F.filter("_g", lambda s: (F.col(global_pos) > s["offset"]) & (F.col(global_pos) <= s["offset"] + s["length"]))
    out = out.withColumn("_s", F.get(hit, F.lit(0)))
    return out.select(*df.columns, F.col("_s.chrom").alias("chrom"), (F.col(global_pos) - F.col("_s.offset")).alias("pos"))


def sample_order_code(values: dict[str, Column], slop: float) -> Column:
    """`b>ac`: samples by falling value, those within `slop` of the one before joined in name order."""
    pairs = F.array(*[F.struct((-c).alias("neg"), F.lit(k).alias("id")) for k, c in values.items()])
    start = F.struct(F.lit("").alias("done"), F.array().cast("array<string>").alias("tied"), F.lit(None).cast("double").alias("last"))

    def step(acc, p):
        v = -p["neg"]
        tie = acc["last"].isNull() | (v + slop >= acc["last"])
        closed = F.concat(acc["done"], F.array_join(F.array_sort(acc["tied"]), ""), F.lit(">"))
        return F.struct(
            F.when(tie, acc["done"]).otherwise(closed).alias("done"),
            F.when(tie, F.concat(acc["tied"], F.array(p["id"]))).otherwise(F.array(p["id"])).alias("tied"),
            v.cast("double").alias("last"))

    return F.aggregate(F.array_sort(pairs), start, step,
                       lambda acc: F.concat(acc["done"], F.array_join(F.array_sort(acc["tied"]), "")))


# Barcodes and quality limits (64-based scale).
BARCODES = ["ACG", "CAT", "GTA", "TGC"]
PERFECT_QUALITY = 25
SINGLE_ERROR_QUALITY = 25


def barcode_split(reads: DataFrame, barcodes: Sequence[str] = tuple(BARCODES), offset: int = 64,
                  perfect: int = PERFECT_QUALITY, single: int = SINGLE_ERROR_QUALITY) -> DataFrame:
    """Bin of each read by its leading barcode (at most one mismatch) and the read without it.

    The barcode list is a literal inside the row expression: no join. The last barcode that
    matches decides.
    """
    n = len(barcodes[0])
    code, marks = F.substring("seq", 1, n), F.split(F.substring("qual", 1, n), "")
    good = lambda limit: F.size(F.filter(marks, lambda c: quality(c, offset) >= limit))
    result = F.lit("unknown_barcodes")
    for bc in barcodes:
        h = hamming(code, F.lit(bc))
        clean = ((h == 0) & (good(perfect) == n)) | ((h == 1) & (good(single) >= n - 1))
        result = F.when(h <= 1, F.when(clean, F.lit(bc)).otherwise(F.lit("lowQual_barcodes"))).otherwise(result)
    kept = F.lit(False)
    for bc in barcodes:
        h = hamming(code, F.lit(bc))
        kept = kept | ((h == 0) & (good(perfect) == n)) | ((h == 1) & (good(single) >= n - 1))
    trimmed = F.when(kept, F.substring("seq", 6, 1 << 30)).otherwise(F.col("seq"))
    return reads.select("*", code.alias("code"), result.alias("bin"), trimmed.alias("seq_out"))
