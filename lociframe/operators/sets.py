"""Track and feature set operations, ordering and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions.intervals import chrom_number
from lociframe.operators.aggregates import type_segments
from lociframe.operators.lookups import cap_identical
from lociframe.operators.piles import place


def combine_tracks(tracks: dict[str, DataFrame]) -> DataFrame:
    """Union with the track name as `source`."""
    out = None
    for name, df in tracks.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def dedup_exact(features: DataFrame, order: str) -> DataFrame:
    """One feature per (chrom, start, end): the first by `order`. Copies collapse map-side."""
    row = F.min_by(F.struct(*features.columns), order)
    return features.groupBy("chrom", "start_pos", "end_pos").agg(row.alias("_r")).select("_r.*")


def dedup_prefer(features: DataFrame, gene: str, order: str) -> DataFrame:
    """One feature per (chrom, start, end, strand), preferring those that name a gene."""
    row = F.min_by(F.struct(*features.columns), F.struct(F.col(gene).isNull().alias("g"), F.col(order).alias("o")))
    return features.groupBy("chrom", "start_pos", "end_pos", "strand").agg(row.alias("_r")).select("_r.*")


def except_features(a: DataFrame, b: DataFrame, on: Sequence[str] = ("chrom", "start_pos", "end_pos", "strand")) -> DataFrame:
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def mask_track(track: DataFrame, mask: DataFrame, inverse: bool = False, on: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    """Positions present in the mask (absent, when inverse)."""
    return track.join(mask.select(*on).distinct(), list(on), "left_anti" if inverse else "left_semi")


def add_tracks(a: DataFrame, b: DataFrame, value: str = "value", on: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    return a.select(*on, value).unionByName(b.select(*on, value)).groupBy(*on).agg(F.sum(value).alias(value))


def location_algebra(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Maximal stretches in both (intersection), in either (union) or only in the first (subtract)."""
    from lociframe.operators.tiles import merge_intervals

    two = a.select("chrom", "start_pos", "end_pos").withColumn("feat_type", F.lit("a")).unionByName(
        b.select("chrom", "start_pos", "end_pos").withColumn("feat_type", F.lit("b")))
    masks = {"intersection": [3], "union": [1, 2, 3], "subtract": [1]}[op]
    seg = type_segments(two, ["a", "b"]).filter(F.col("mask").isin(masks))
    out = seg.select("chrom", F.col("seg_start").alias("start_pos"), F.col("seg_end").alias("end_pos"))
    return merge_intervals(out, ["chrom"], gap=2)


def genome_sort(features: DataFrame, by_end: bool = False) -> DataFrame:
    """Natural chromosome order, then start (or end, start, strand): a range-partitioned global sort."""
    rest = ["end_pos", "start_pos", "strand"] if by_end else ["start_pos", "end_pos"]
    return features.orderBy(chrom_number(F.col("chrom")), F.col("chrom"), *rest)


def first_reads(reads: DataFrame, n: int, order: str = "read_id") -> DataFrame:
    return reads.orderBy(order).limit(n)


def _unit(*parts) -> Column:
    """Seeded uniform in [0, 1) from a hash of the row key: the same on every retry."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def downsample_counts(df: DataFrame, frac: float, seed: int, counts: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Binomial thinning: each read of a count survives with probability `frac`."""
    def thin(c: str) -> Column:
        ks = F.when(F.col(c) > 0, F.sequence(F.lit(1).cast("bigint"), F.col(c).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        return F.size(F.filter(ks, lambda k: _unit(*[F.col(x) for x in key], F.lit(c), k, F.lit(seed)) < frac)).cast("bigint")

    return df.withColumns({c: thin(c) for c in counts})


def downsample_rows(df: DataFrame, frac: float, seed: int, key: Sequence[str]) -> DataFrame:
    return df.filter(_unit(*[F.col(x) for x in key], F.lit(seed)) < frac)


def downsample_depth(bases: DataFrame, depth: int, seed: int) -> DataFrame:
    """At most `depth` bases per position, picked by a seeded hash of the read."""
    order = F.xxhash64("read_id", F.lit(seed))
    return cap_identical(bases.withColumn("_o", order), place(bases), depth, "_o").drop("_o")


def spread_rank(df: DataFrame, keys: Sequence[str], order: Column, buckets: int = 1024, name: str = "rank") -> DataFrame:
    """1-based rank of each row inside `keys` by a hash `order`, without a window over a whole group.

    Rows rank inside hash buckets; the bucket counts give each bucket its first rank.
    """
    b = df.withColumn("_o", order).withColumn("_b", F.pmod(F.col("_o"), F.lit(buckets)))
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o", *[c for c in df.columns if c not in keys]))
    return b.withColumn(name, local).join(sizes, [*keys, "_b"]).withColumn(name, F.col(name) + F.col("_skip")).drop("_o", "_b", "_skip")


def shuffle_values(df: DataFrame, values: Sequence[str], keys: Sequence[str], pos: str, seed: int) -> DataFrame:
    """Values dealt out at random over the positions of their group (null model)."""
    keys, ident = list(keys), [F.col(k) for k in keys]
    places = spread_rank(df.select(*keys, *[c for c in df.columns if c not in keys and c not in values]), keys,
                         F.xxhash64(*ident, F.col(pos), F.lit(seed)))
    cards = spread_rank(df.select(*keys, pos, *values), keys, F.xxhash64(*ident, F.col(pos), F.lit(seed + 1))).drop(pos)
    return places.join(cards, [*keys, "rank"]).drop("rank").select(*df.columns)


def random_intervals(features: DataFrame, sizes: DataFrame, seed: int, key: str = "feat_id") -> DataFrame:
    """Each feature moved to a uniform random place where its length fits inside a chromosome.

    The start is drawn among all valid starts of the genome, which equals redrawing until it fits.
    """
    stretch = sizes.agg(F.array_sort(F.collect_list(F.struct("chrom", F.col("length").cast("bigint").alias("length"))))).scalar()
    length = (F.col("end_pos") - F.col("start_pos") + 1).cast("bigint")
    d = features.withColumns({"_z": stretch, "_len": length})
    room = F.transform("_z", lambda s: F.greatest(F.lit(0).cast("bigint"), s["length"] - F.col("_len") + 1))
    d = d.withColumn("_room", room)
    total = F.aggregate("_room", F.lit(0).cast("bigint"), lambda a, x: a + x)
    d = d.withColumn("_u", F.pmod(F.xxhash64(key, F.lit(seed)), total))
    zero = F.struct(F.col("_u").alias("left"), F.lit(None).cast("string").alias("chrom"))
    step = lambda acc, s: F.when(acc["chrom"].isNotNull(), acc).when(acc["left"] < s["r"], F.struct(acc["left"].alias("left"), s["c"].alias("chrom"))).otherwise(
        F.struct((acc["left"] - s["r"]).alias("left"), F.lit(None).cast("string").alias("chrom")))
    pairs = F.zip_with("_z", "_room", lambda z, r: F.struct(z["chrom"].alias("c"), r.alias("r")))
    d = d.filter(total > 0).withColumn("_p", F.aggregate(pairs, zero, step))
    keep = [c for c in features.columns if c not in ("chrom", "start_pos", "end_pos")]
    return d.select(*keep, F.col("_p.chrom").alias("chrom"), (F.col("_p.left") + 1).alias("start_pos"), (F.col("_p.left") + F.col("_len")).alias("end_pos"))


def depth_counts_subsets(bases: DataFrame, frac: float, trials: int, seed: int) -> DataFrame:
    """Mean number of positions per depth over seeded random subsets of the reads."""
    t = F.explode(F.array(*map(F.lit, range(trials))))
    picked = bases.select(*place(bases), "read_id", t.alias("trial")).filter(_unit(F.col("read_id"), F.col("trial"), F.lit(seed)) < frac)
    d = picked.groupBy("trial", *place(bases)).agg(F.count(F.lit(1)).alias("depth"))
    return d.groupBy("depth").agg((F.count(F.lit(1)) / trials).alias("mean_positions"))


def write_chunks(df: DataFrame, path: str, rows_per_file: int) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One folder per value of `by` (source, type, sequence, name); hot values keep several writers."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
