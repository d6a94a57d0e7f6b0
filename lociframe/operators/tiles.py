"""Ordered work along a chromosome without one task per chromosome.

A window partitioned by (sample, chrom) sorts a whole chromosome in one task. Here the
coordinate is cut into tiles of fixed width and the ordered work runs per (keys, tile);
what a tile needs from outside comes in one of three exact ways:

* `position_halo`  - copies of the rows within a fixed distance (bounded frames),
* `row_halo`       - the last/first k rows of the neighbouring non-empty tiles (lag/lead),
* `running`        - one carry row per tile for running sums and maxima.

Coordinates are 32-bit, so a group has at most 2^31 / TILE tiles and the window over the
tile summaries stays small whatever the data volume. Callers whose positions repeat
aggregate to distinct positions first, which bounds a tile by its width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import settle

TILE = 1 << 14


def tile_of(pos: Column | str, width: int = TILE) -> Column:
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(col / F.lit(width)).cast("bigint")


def tile_window(keys: Sequence[str], *order) -> "Window":
    return Window.partitionBy(*keys, "_tile").orderBy(*order)


def position_halo(df: DataFrame, pos: str, before: int, after: int = 0, width: int = TILE) -> DataFrame:
    """Copy each row to every tile whose rows look at it; `_home` marks the row's own tile.

    A row at q looks at q-before .. q+after, so a row at p is wanted by tiles of
    p-after .. p+before. Use a range frame per (keys, _tile), then keep `_home` rows.
    """
    width = max(width, before + after + 1)
    tiles = F.sequence(tile_of(F.col(pos) - after, width), tile_of(F.col(pos) + before, width))
    out = df.withColumn("_tile", F.explode(tiles))
    return out.withColumn("_home", F.col("_tile") == tile_of(pos, width))


def row_halo(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int = 0,
    after: int = 0,
    order: Sequence[str] | None = None,
    width: int = TILE,
) -> DataFrame:
    """Add to each tile the `before` preceding and `after` following rows of its group.

    lag(k <= before) and lead(k <= after) over (keys, _tile) are then exact for `_home` rows.
    """
    order = list(order or [pos])
    cols = df.columns
    tiled = df.withColumn("_tile", tile_of(pos, width)).withColumn("_home", F.lit(True))
    out = tiled
    row = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*[F.col(c) for c in order])

    def edge(k: int, last: bool) -> DataFrame:
        if k == 1:
            pick = F.max_by(row, rank) if last else F.min_by(row, rank)
            ends = tiled.groupBy(*keys, "_tile").agg(F.array(pick).alias("_rows"))
        else:
            ordering = [F.desc(c) if last else F.asc(c) for c in order]
            ranked = tiled.withColumn("_rk", F.row_number().over(tile_window(keys, *ordering)))
            ends = (
                ranked.filter(F.col("_rk") <= k)
                .groupBy(*keys, "_tile")
                .agg(F.sort_array(F.collect_list(F.struct(rank.alias("o"), row.alias("r")))).alias("_rows"))
                .withColumn("_rows", F.transform("_rows", lambda x: x["r"]))
            )
        frame = Window.partitionBy(*keys).orderBy("_tile")
        frame = frame.rowsBetween(-k, -1) if last else frame.rowsBetween(1, k)
        near = F.flatten(F.collect_list("_rows").over(frame))
        wanted = F.reverse(F.slice(F.reverse(near), 1, k)) if last else F.slice(near, 1, k)
        return (
            ends.select(*keys, F.col("_tile").alias("_to"), wanted.alias("_rows"))
            .select("_to", F.explode("_rows").alias("r"))
            .select("r.*", F.col("_to").alias("_tile"), F.lit(False).alias("_home"))
        )

    if before:
        out = out.unionByName(edge(before, True))
    if after:
        out = out.unionByName(edge(after, False))
    return out


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    order: Sequence[str] | None = None,
    inclusive: bool = True,
    width: int = TILE,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    peers: bool = False,
) -> DataFrame:
    """Running sums / maxima along `pos` inside `keys`, exact across tiles.

    `inclusive=False` leaves the current row out (what has been seen before it); `peers=True` takes
    in all rows of the current position, so positions may repeat.
    """
    sums, maxes = sums or {}, maxes or {}
    order = list(order or [pos])
    tiled = df.withColumn("_tile", tile_of(pos, width))
    work = [(n, c, F.sum) for n, c in sums.items()] + [(n, c, F.max) for n, c in maxes.items()]
    totals = tiled.groupBy(*keys, "_tile").agg(*[fn(c).alias(f"_t_{n}") for n, c, fn in work])
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_tile", *[fn(f"_t_{n}").over(before).alias(f"_c_{n}") for n, _, fn in work])
    local = tile_window(keys, *order)
    local = local.rangeBetween(Window.unboundedPreceding, 0) if peers else local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = tiled.join(carry, [*keys, "_tile"])
    for name, col, fn in work:
        here, ahead = fn(col).over(local), F.col(f"_c_{name}")
        if fn is F.sum:
            value = F.coalesce(here + ahead, here, ahead, F.sum(col).over(local))
        else:
            value = F.greatest(ahead, here)
        out = out.withColumn(name, value)
    return out.drop("_tile", *[f"_c_{n}" for n, _, _ in work])


def running_at(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    ask: str,
    sums: dict[str, Column],
    parts: int,
    width: int = TILE,
) -> DataFrame:
    """Running sums along `pos` inside `keys` at the rows that `ask` marks; all rows of a position count.

    Rows go to their tile once, in `parts` partitions. What is kept of them are the asking rows and the
    last of each tile, which holds the tile's total. Rows without a key or position are left out.
    """
    w = tile_window(keys, pos)
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    tiled = df.withColumn("_tile", tile_of(pos, width)).repartition(parts, *keys, "_tile")
    local = tiled.select(*keys, "_tile", pos, ask, F.lead(F.lit(True)).over(w).isNull().alias("_last"),
                         *[F.sum(c).over(upto).alias(f"_h_{n}") for n, c in sums.items()])
    kept = settle(local.filter(F.col(ask) | F.col("_last")))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = kept.filter("_last").select(*keys, "_tile", *[F.sum(f"_h_{n}").over(before).alias(f"_c_{n}") for n in sums])
    here = lambda n: F.col(f"_h_{n}")
    ahead = lambda n: F.col(f"_c_{n}")
    return kept.filter(ask).join(carry, [*keys, "_tile"]).select(
        *keys, pos, *[F.coalesce(here(n) + ahead(n), here(n), ahead(n)).alias(n) for n in sums])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: int = 1,
    width: int = TILE,
) -> DataFrame:
    """Label intervals that chain together: new island when start > max(previous ends) + gap - 1.

    gap=1 joins intervals that share a base; gap=2 also joins those that touch.
    Adds `island` (start of the island). Hot starts collapse before the ordered pass and
    the label returns through an equi-join on (keys, start).
    """
    spots = settle(df.groupBy(*keys, start).agg(F.max(end).alias("_e")))
    seen = running(spots, keys, start, inclusive=False, width=width, maxes={"_prev": F.col("_e")})
    fresh = F.when(F.col("_prev").isNull() | (F.col(start) > F.col("_prev") + (gap - 1)), F.col(start))
    labels = running(seen.withColumn("_new", fresh), keys, start, width=width, maxes={"island": F.col("_new")})
    return df.join(labels.select(*keys, start, "island"), [*keys, start])


def local_chains(
    df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 1, width: int = TILE, **payload: Column
) -> DataFrame:
    """Intervals chained within the tile of their start: one row per local chain, in one shuffle.

    `payload` columns are aggregated along (map-side by start first, so they must be mergeable:
    min, max and sum of themselves).
    """
    spots = df.groupBy(*keys, tile_of(start, width).alias("_tile"), start).agg(
        F.max(end).alias(end), *[c.alias(n) for n, c in payload.items()])
    w = tile_window(keys, start)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(far.isNull() | (F.col(start) > far + (gap - 1)), 1).otherwise(0)
    marked = spots.withColumn("_new", fresh).withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_tile", "_isl").agg(
        F.min(start).alias(start), F.max(end).alias(end),
        *[(F.sum(n) if n.startswith("n_") else F.min(n)).alias(n) for n in payload]).drop("_tile", "_isl")


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start_pos", end: str = "end_pos", gap: int = 1
) -> DataFrame:
    """Disjoint union of the intervals per `keys`."""
    # chains inside a tile merge first: what is left is disjoint but for tile borders
    spots = settle(local_chains(df, keys, start, end, gap).groupBy(*keys, start).agg(F.max(end).alias(end)))
    return (
        islands(spots, keys, start, end, gap)
        .groupBy(*keys, "island")
        .agg(F.max(end).alias(end))
        .withColumnRenamed("island", start)
        .select(*keys, start, end)
    )


def cover_pieces(
    df: DataFrame, keys: Sequence[str], start: str = "start_pos", end: str = "end_pos", width: int = TILE
) -> DataFrame:
    """Disjoint pieces with the same bases as the union of the intervals, in one shuffle.

    Intervals are cut at tile borders and merged inside each tile, so a stretch that crosses
    a border stays as touching pieces: enough for every membership test, and no carry between
    tiles is needed. Equal starts collapse before the shuffle.
    """
    first, last = tile_of(start, width), tile_of(end, width)
    cut = df.select(*keys, start, end, F.explode(F.sequence(first, last)).alias("_tile")).select(
        *keys, "_tile",
        F.greatest(F.col(start), (F.col("_tile") * width).cast("int")).alias("_s"),
        F.least(F.col(end), ((F.col("_tile") + 1) * width - 1).cast("int")).alias("_e"))
    spots = cut.groupBy(*keys, "_tile", "_s").agg(F.max("_e").alias("_e"))
    w = tile_window(keys, "_s")
    far = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spots.withColumn("_new", F.when(far.isNull() | (F.col("_s") > far), 1).otherwise(0))
    marked = fresh.withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_tile", "_isl").agg(F.min("_s").alias(start), F.max("_e").alias(end)).select(*keys, start, end)
