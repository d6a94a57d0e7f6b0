"""Read bases dealt by place before the reads are cut into them.

Questions about positions group the bases of all reads that cover one. If the bases themselves, or partial
sums of them, move to their position, most of the job is that exchange. Here the reads move, to the tiles
they lie in, and are cut into bases there: a read is a few hundred bytes, and what follows per tile and
position needs no further exchange.

Sums over the bases of a position (`base_sums`) are made from the reads themselves, many tiles at a time in
Arrow batches: a position costs a row there, not its bases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.tiles import tile_of

PILE = 1 << 12
STRANDS = "+-"
BASES = "ACGT"
PILE_GAP = 1 << 10  # no neighbour is so far


@dataclass(frozen=True)
class Dealt:
    """Reads dealt by tile, from which the bases of a table are cut."""

    reads: DataFrame
    halo: int
    width: int


def tiled_bases(reads: DataFrame, halo: int = 0, parts: int | None = None, width: int = PILE) -> DataFrame:
    """One row per read and reference position, dealt by `tile`.

    reads: read_id, chrom, start_pos, strand, mapq, seq, ref, qual, the strings of equal length. A tile also
    gets the bases up to `halo` positions outside; `home` then marks its own. `parts` is the number of
    partitions; without it Spark's setting holds. Reads without a place stay together, with tile null.
    """
    size = F.length("ref")
    first, last = tile_of(F.col("start_pos") - halo, width), tile_of(F.col("start_pos") + size - 1 + halo, width)
    none = F.array(F.lit(None).cast("bigint"))
    dealt = reads.select("read_id", "chrom", "start_pos", "strand", "mapq", "seq", "ref", "qual",
                         F.explode(F.coalesce(F.when(size > 0, F.sequence(first, last)), none)).alias("tile"))
    dealt = dealt.repartition(parts, "chrom", "tile") if parts else dealt.repartition("chrom", "tile")
    big = size.cast("bigint")
    low = F.greatest(F.col("tile") * width - halo - F.col("start_pos") + 1, F.lit(1).cast("bigint"))
    high = F.least((F.col("tile") + 1) * width + halo - F.col("start_pos"), big)
    home = [F.coalesce(tile_of(F.col("start_pos") + F.col("i") - 1, width) == F.col("tile"), F.lit(True)).alias("home")] if halo else []
    cut = dealt.filter(big > 0).withColumn("i", F.explode(F.when(F.col("tile").isNull(), F.sequence(F.lit(1).cast("bigint"), big)).otherwise(F.sequence(low, high))))
    i, pos = F.col("i"), F.col("start_pos") + F.col("i") - 1
    at = lambda text, k: F.substring(F.col(text), k.cast("int"), F.lit(1))
    out = cut.select(
        "read_id", "chrom", pos.alias("pos"), "strand", "mapq", i.alias("off"), F.when(F.col("strand") == "+", i).otherwise(big + 1 - i).alias("cycle"),
        at("ref", i).alias("ref_base"), at("seq", i).alias("base"), (F.ascii(at("qual", i)) - 33).alias("qual"),
        F.when(i > 1, at("ref", i - 1)).alias("prev_ref"), F.when(i < big, at("ref", i + 1)).alias("next_ref"),
        F.when(i < big - 1, at("ref", i + 2)).alias("next2_ref"), "tile", *home)
    out.dealt = Dealt(dealt, halo, width)  # of this table only, not of what is selected from it
    return out


def dealt_reads(bases: DataFrame) -> Dealt | None:
    """The reads behind a table of `tiled_bases` that holds all their bases."""
    return bases.__dict__.get("dealt")


def near_tiles(df: DataFrame, pos: str, before: int, after: int) -> DataFrame:
    """Rows with the tile they are needed in: as they were dealt, else dealt here with what a row looks at,
    `before` positions before it to `after` behind it. Rows without a place are left out."""
    if "tile" not in df.columns:
        tiles = F.sequence(tile_of(F.col(pos) - after, PILE), tile_of(F.col(pos) + before, PILE))
        df = df.withColumn("tile", F.explode(tiles))
        df = df.withColumn("home", F.col("tile") == tile_of(pos, PILE)).repartition("chrom", "tile")
    return df.filter(F.col("chrom").isNotNull() & F.col("tile").isNotNull())


def place(df: DataFrame, *more: str) -> list[str]:
    """Grouping columns of a position, with those of the tile by which the rows are dealt if they have them."""
    return ["chrom", *[c for c in ("tile", "home") if c in df.columns], "pos", *more]


def beside_name(k: int, base: str = "ref_base") -> str:
    return f"{base}_{'m' if k < 0 else 'p'}{abs(k)}"


def base_sums(dealt: Dealt, terms: Callable[[np.ndarray], np.ndarray], names: list[str], by_strand: bool = False, around: int = 0) -> DataFrame:
    """chrom, tile, pos and ref_base (with `home` where there is a halo) with depth and sums over the bases there.

    `terms` takes quality values (NaN for null) and gives what a base adds to each sum, NaN for nothing: strand (+, -, neither,
    null) by base (A, C, G, T, other, null) by quality by name. A sum to which no base adds is null. `by_strand` adds sums
    of the + and of the - reads (0 if empty), as name_fw and name_rev.
    `around` adds the reference bases next to the position, as `lookups.base_neighbours` does; the halo has to hold them.
    """
    kinds = ["chrom string", "tile bigint", *["home boolean"] * (dealt.halo > 0), "pos bigint", "ref_base string", "depth bigint"]
    kinds += [f"{n}{x} double" for x in (["", "_fw", "_rev"] if by_strand else [""]) for n in names]
    beside = [k for k in range(-around, around + 1) if k]
    kinds += [f"{beside_name(k)} string" for k in beside]
    labels = [k.split()[0] for k in kinds]
    width, halo, most = dealt.width, dealt.halo, len(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile = _Pile(width, halo, terms, most, by_strand, beside, labels)
        for batch in batches:
            if batch.num_rows:
                yield from pile.add(*batch.columns)
        if pile.open:
            yield pile.end()

    rows = dealt.reads.filter(F.length("ref") > 0).select("chrom", "tile", "start_pos", "strand", "seq", "ref", "qual")
    out = rows.sortWithinPartitions("chrom", "tile").mapInArrow(sums, ", ".join(kinds))
    out.by_tile = True  # rows of a tile follow one another
    return out


def by_tile(df: DataFrame) -> bool:
    return df.__dict__.get("by_tile", False)


def beside(rows: DataFrame, base: str, around: int, totals: list[str]) -> DataFrame:
    """`lookups.base_neighbours` of rows (chrom, tile, home, pos, base, totals) whose tiles follow one another: they stay where they are.

    Each row also gets the sums of `totals` over all rows of its position.
    """
    steps = [k for k in range(-around, around + 1) if k]
    labels = ["chrom", "pos", base, *[beside_name(k, base) for k in steps], *totals]

    def found(t: pa.Table) -> pa.RecordBatch:
        chrom = t["chrom"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        tile, pos = t["tile"].to_numpy(), t["pos"].to_numpy()
        group = np.cumsum(np.append(True, (chrom[1:] != chrom[:-1]) | (tile[1:] != tile[:-1]))) - 1
        key = group * (PILE_GAP + int(np.ptp(pos))) + pos - pos.min()
        kinds = sorted(set(t[base].unique().to_pylist()))
        codes = t[base].combine_chunks().dictionary_encode()
        letter = np.array([kinds.index(x) for x in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()]
        order = np.lexsort((letter, key))
        last = order[np.flatnonzero(np.diff(key[order], append=-1))]
        held, names, here = key[last], pa.array(kinds, pa.string()), np.searchsorted(key[last], key)
        values = [t["chrom"].combine_chunks(), t["pos"].combine_chunks(), t[base].combine_chunks()]
        for k in steps:
            there = np.minimum(np.searchsorted(held, key + k), len(held) - 1)
            values.append(names.take(pa.array(letter[last][there], mask=held[there] != key + k)))
        values += [pa.array(np.rint(np.bincount(here, t[c].to_numpy(), len(held))[here]).astype(np.int64)) for c in totals]
        return pa.RecordBatch.from_arrays(values, labels).filter(t["home"].combine_chunks())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            ends = [t["chrom"][-1].as_py(), t["tile"][-1].as_py()]
            chrom, tile = t["chrom"].combine_chunks().dictionary_encode(), t["tile"].to_numpy()
            at = chrom.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            other = np.flatnonzero((tile != ends[1]) | (at != at[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield found(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield found(held)

    kinds = ["chrom string", "pos bigint", f"{base} string", *[f"{beside_name(k, base)} string" for k in steps], *[f"{c} bigint" for c in totals]]
    return rows.filter(F.col("tile").isNotNull()).select("chrom", "tile", "home", "pos", base, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in totals]).mapInArrow(stream, ", ".join(kinds))


def _codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """Bytes and offsets of texts in which each byte is a letter."""
    if text.null_count:
        return None
    raw = text.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return None if len(data) and data.max() > 127 else (data, ends - ends[0])


def aligned_letters(first: pa.Array, *others: tuple[pa.Array, int]) -> list[np.ndarray]:
    """Letters of texts as long as `first`, and offsets by row; the others come with the letter that stands for null.

    Row by row where a text is null, of another length or not ASCII; what a shorter one lacks is 0.
    """
    plain = [_codes(x) for x in (first, *[x for x, _ in others])]
    if all(plain) and all(np.array_equal(plain[0][1], x[1]) for x in plain[1:]):
        return [*[x[0].astype(np.int32) for x in plain], plain[0][1]]
    fit = lambda text, n, none: [none] * n if text is None else [ord(c) for c in text[:n]] + [0] * (n - len(text))
    sizes = [len(x) for x in first.to_pylist()]
    flat = [np.array([c for x, n in zip(rows.to_pylist(), sizes, strict=True) for c in fit(x, n, none)], np.int32) for rows, none in ((first, 0), *others)]
    return [*flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]


class _Pile:
    """Sums of the bases of reads that come tile by tile; a tile's rows go out once another follows."""

    def __init__(self, width: int, halo: int, terms: Callable[[np.ndarray], np.ndarray], most: int, by_strand: bool, beside: list[int], labels: list[str]):
        self.width, self.halo, self.terms, self.most, self.by_strand, self.beside, self.labels = width, halo, terms, most, by_strand, beside, labels
        self.sets = 3 if by_strand else 1
        self.known: tuple[np.ndarray, np.ndarray, bool] | None = None
        self.open: list[np.ndarray] = []  # place, letter, depth, sums, bases that add nothing; of the tile not yet ended
        self.at: tuple[str | None, int | None] = None, None

    def _table(self, quals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms by code and name, and whether they are missing; a code is strand, base, place in `quals`."""
        t = self.terms(np.where(quals < 0, np.nan, quals - 33.0)).reshape(-1, self.most)
        return np.where(np.isnan(t), 0.0, t), np.isnan(t)

    def add(self, chrom: pa.Array, tile: pa.Array, start: pa.Array, strand: pa.Array, seq: pa.Array, ref: pa.Array, qual: pa.Array) -> Iterator[pa.RecordBatch]:
        placed = tile.is_valid().to_numpy(zero_copy_only=False)
        t, s = (x.fill_null(0).cast(pa.int64()).to_numpy() for x in (tile, start))
        names = chrom.dictionary_encode()
        name = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (placed[1:] != placed[:-1]) | (name[1:] != name[:-1])
        first = np.flatnonzero(new)
        at = [*zip(chrom.take(pa.array(first)).to_pylist(), tile.take(pa.array(first)).to_pylist(), strict=True)]
        apart = bool(self.open) and at[0] != self.at
        if apart:
            yield self.end()
        group = np.cumsum(new) - 1
        letters, bases, quals, offsets = aligned_letters(ref, (seq, -1), (qual, -1))
        size, left = np.diff(offsets), t * self.width - self.halo
        reach = self.width + 2 * self.halo
        low = np.where(placed, np.maximum(left - s, 0), 0)
        high = np.where(placed, np.minimum(left + reach - s, size), size)
        n = np.maximum(high - low, 0)
        ahead = np.cumsum(n) - n
        k = np.arange(int(n.sum()))
        each = lambda v: np.repeat(v, n)
        byte = k + each(offsets[:-1] + low - ahead)
        place = np.where(each(placed), k + each(s - left + low - ahead), 0) if not placed.all() else k + each(s - left + low - ahead)
        ref_seen = letters[byte]
        seen = np.flatnonzero(np.bincount(ref_seen)) if len(byte) else np.zeros(0, np.int64)
        dense = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
        dense[seen] = np.arange(len(seen))
        key = (each(group * reach) + place) * max(len(seen), 1) + dense[ref_seen]
        cells = (int(group[-1]) + 1) * reach * max(len(seen), 1)
        if cells <= 8 * len(key) + (1 << 20):
            per = np.bincount(key, minlength=cells)
            keys = np.flatnonzero(per)
            depth = per[keys]
            per[keys] = np.arange(len(keys))
            index = per[key]
        else:
            keys, index, depth = np.unique(key, return_inverse=True, return_counts=True)
        added, nothing = self._sum(index, len(keys), bases[byte], quals[byte], each(self._strands(strand)))
        where, letter = keys // max(len(seen), 1), seen[keys % max(len(seen), 1)] if len(seen) else keys
        rows = [where // reach, where % reach, letter, depth, added, nothing]
        cut = int(np.searchsorted(rows[0], len(at) - 1))
        if self.open:  # the first tile goes on from the last batch
            first = int(np.searchsorted(rows[0], 0, "right"))
            whole = self._merged([r[..., :first] for r in rows[1:]])
            if len(at) == 1:
                self.open = whole
                return
            yield self._rows([np.zeros_like(whole[0]), *whole], at)
            rows, cut = [r[..., first:] for r in rows], cut - first
        self.open, self.at = [r[..., cut:] for r in rows[1:]], at[-1]
        yield self._rows([r[..., :cut] for r in rows], at)

    def end(self) -> pa.RecordBatch:
        rows = [np.zeros_like(self.open[0]), *self.open]
        self.open = []
        return self._rows(rows, [self.at])

    def _strands(self, strand: pa.Array) -> np.ndarray:
        kinds = strand.dictionary_encode()
        of = [3 if x is None else STRANDS.find(x) if x in ("+", "-") else 2 for x in kinds.dictionary.to_pylist()] + [3]
        return np.array(of, np.int64)[kinds.indices.fill_null(len(of) - 1).to_numpy(zero_copy_only=False)]

    def _sum(self, index: np.ndarray, n: int, bases: np.ndarray, quals: np.ndarray, strands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(quals) and quals.max() > 127:
            known, place = np.unique(quals, return_inverse=True)
            table, void = self._table(known)
        else:
            if self.known is None:
                self.known = self._table(np.arange(-1, 128))
            (table, void), known, place = self.known, np.arange(-1, 128), quals + 1
        kind = np.full(257, len(BASES), np.int64)
        kind[-1] += 1
        kind[[ord(b) for b in BASES]] = range(len(BASES))
        code = (strands * (len(BASES) + 2) + kind[np.minimum(bases, 255)]) * len(known) + place
        sums = np.zeros((self.sets * self.most, n))
        nothing = np.zeros((self.most, n), np.int64)
        some = void[np.flatnonzero(np.bincount(code))].any(axis=0)
        own = [slice(None)] + ([strands == 0, strands == 1] if self.by_strand else [])
        for j, rows in enumerate(own):
            i, c = index[rows], code[rows]
            for g in range(self.most):
                sums[j * self.most + g] = np.bincount(i, table[:, g][c], n)
                if j == 0 and some[g]:
                    nothing[g] = np.bincount(i[void[:, g][c]], minlength=n)
        return sums, nothing

    def _merged(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Rows of the open tile with what another batch has of it."""
        place, letter, depth, sums, nothing = (np.concatenate([a, b], axis=-1) for a, b in zip(self.open, rows, strict=True))
        _, one, back = np.unique(place * (1 << 21) + letter, return_index=True, return_inverse=True)
        add = lambda v: np.stack([np.bincount(back, x, len(one)) for x in np.atleast_2d(v)])
        whole = lambda v: np.rint(add(v)).astype(np.int64)
        return [place[one], letter[one], whole(depth)[0], add(sums), whole(nothing)]

    def _rows(self, rows: list[np.ndarray], at: list[tuple[str | None, int | None]]) -> pa.RecordBatch:
        of, place, letter, depth, sums, nothing = rows
        tiles = np.array([x or 0 for _, x in at], np.int64)[of]
        lost = np.array([x is None for _, x in at], bool)[of]
        kinds, which = np.unique(letter, return_inverse=True)
        values = [pa.array([c for c, _ in at], pa.string()).take(pa.array(of)), pa.array(tiles, mask=lost)]
        if self.halo:
            values.append(pa.array(lost | ((place >= self.halo) & (place < self.halo + self.width))))
        values += [pa.array(tiles * self.width - self.halo + place, mask=lost), pa.array([chr(c) for c in kinds], pa.string()).take(pa.array(which)), pa.array(depth)]
        values += [pa.array(v, mask=(nothing[j] == depth) if j < self.most else None) for j, v in enumerate(sums)]
        key = of * (self.width + 4 * self.halo) + place
        last = np.flatnonzero(np.diff(key, append=-1))  # letters rise within a place
        held, names = key[last], pa.array([chr(c) for c in kinds], pa.string())
        for k in self.beside:
            there = np.minimum(np.searchsorted(held, key + k), max(len(held) - 1, 0))
            values.append(names.take(pa.array(which[last][there], mask=lost | (held[there] != key + k))) if len(key) else pa.array([], pa.string()))
        return pa.RecordBatch.from_arrays(values, self.labels)
