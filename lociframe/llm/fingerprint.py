"""Document fingerprints: improbable windows of bytes in chained Bloom filters.

Every 64-byte window of a text has an entropy, in 1001 steps. `rarity` counts the steps over the
windows of all texts (summed per task before they move; 1001 numbers reach the driver) and ranks
them, rarest first. Among every 64 neighbouring windows the rarest, leftmost one gains a point;
windows with at least 16 points are the features of a text. Their hashes set five bits each in a
filter of 2048 bits; after 160 features a further filter is chained. Two fingerprints are compared
by the share of bits that the filters have in common, less what chance gives, over the most that
they could have: each filter of the shorter chain against its best partner, averaged.

Window counts come from 63 shifted comparisons of the whole byte array, sums over windows from
running sums of exact integers, and least ranks of neighbours from six doubling steps, so a
fingerprint does not depend on what else its task holds.

`compare_with_next` sends the texts through one range partitioning by id. Every task meets its rows
in order and holds a slice of texts and one row; only the last row of each partition waits for the
first row of the next, in a table with one row per partition.

Defined results: null and empty texts have no features (likeness 1 to each other, 0 to others);
texts in which no window is chosen have one feature, the whole text; rows with equal ids follow each
other by the digest of their text; null ids come last; a single row is its own next; other columns
don't matter; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lociframe.llm.common import raw, settle, slices, table

WINDOW, POINTS, PER_FILTER, BITS, PICKS = 64, 16, 160, 2048, 5
STEPS = 1000
LEAST_STEP = 160  # windows under about one bit of entropy say nothing
_SCALE = 1 << 20
_C_LOG_C = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_GAIN = np.diff(_C_LOG_C)
_FULL = 6 * WINDOW * _SCALE
_BLOCK = 1 << 16
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def steps(data: np.ndarray) -> np.ndarray:
    """Entropy of every window of a byte array, from 0 to STEPS."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the 63 before and after
    for lo in range(0, n, _BLOCK):
        a, b = max(lo - WINDOW + 1, 0), min(lo + _BLOCK + WINDOW - 1, n)
        part = data[a:b]
        one, two = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for d in range(1, min(WINDOW, len(part))):
            same = (part[:-d] == part[d:]).view(np.uint8)
            one[d:] += same
            two[:-d] += same
        hi = min(lo + _BLOCK, n)
        back[lo:hi], ahead[lo:hi] = one[lo - a : hi - a], two[lo - a : hi - a]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _C_LOG_C[np.bincount(data[:WINDOW])].sum()
    total[1:] = _GAIN[back[WINDOW:]] - _GAIN[ahead[: n - WINDOW]]
    np.cumsum(total, out=total)
    return ((_FULL - total) * STEPS // _FULL).astype(np.int16)


def _inside(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """True for starts of ranges of `width` places that lie in one row; for n starts."""
    out = np.ones(n + width, bool)
    for end in at[1:].tolist():
        out[max(end - width + 1, 0) : end] = False
    return out[:n]


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of every entropy step, 1 for the rarest; steps that are not used have none (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(STEPS + 1, np.int64)
        for b in slices(batches, "text"):
            data, at = raw(b.column("text"))
            found = steps(data)
            seen += np.bincount(found[_inside(at, len(found), WINDOW)], minlength=STEPS + 1)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"step": pa.array(used, pa.int32()), "n": pa.array(seen[used])})

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "step int, n long")
    rows = counts.groupBy("step").agg(F.sum("n").alias("n")).collect()  # at most STEPS + 1
    ranks = np.zeros(STEPS + 1, np.int64)
    for rank, (_, step) in enumerate(sorted((r["n"], -r["step"]) for r in rows if r["step"] >= LEAST_STEP)):
        ranks[-step] = rank + 1
    return ranks


def features(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every feature of the rows, and features before each row (n + 1)."""
    found = steps(data)
    m = len(found)
    if m < WINDOW:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = _inside(at, m, WINDOW)
    rank = np.where(inside, ranks[found], 0)
    key = (np.where(rank > 0, rank, STEPS + 2).astype(np.int64) << 40) | np.arange(m)
    least, width = key, 1
    while width < WINDOW:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    whole = _inside(at, m, 2 * WINDOW - 1)[: len(least)]
    best = least[whole]
    points = np.bincount((best & ((1 << 40) - 1))[best >> 40 <= STEPS + 1], minlength=m)
    chosen = np.flatnonzero(points >= POINTS)
    return chosen, np.searchsorted(chosen, at)


def digests(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> list[str]:
    """Fingerprints of the rows: number of features and the filters in hex."""
    chosen, before = features(data, at, ranks)
    text = data.tobytes()
    hashes: list[bytes] = []
    owner: list[int] = []
    place: list[int] = []
    counts = []
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own = [text[s : s + WINDOW] for s in chosen[before[row] : before[row + 1]].tolist()] or ([text[a:b]] if b > a else [])
        own = list(dict.fromkeys(own))
        counts.append(len(own))
        hashes += map(xxh3_128_digest, own)
        owner += [row] * len(own)
        place += range(len(own))
    n_filters = [-(-c // PER_FILTER) for c in counts]
    first = np.append(0, np.cumsum(n_filters)).astype(np.int64)
    filters = np.zeros((int(first[-1]), BITS // 8), np.uint8)
    if hashes:
        low = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)[:, 0]
        which = first[np.array(owner)] + np.array(place) // PER_FILTER
        for k in range(PICKS):
            bit = ((low >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)
            np.bitwise_or.at(filters, (which, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return [f"{c}:{filters[i:j].tobytes().hex()}" for c, i, j in zip(counts, first[:-1], first[1:])]


def likeness(a: str, b: str) -> float:
    """Common bits beyond chance over the most possible, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s.partition(":")[2]), np.uint8).reshape(-1, BITS // 8) for s in (a, b))
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    ones = [_POPCOUNT[z].sum(axis=1, dtype=np.int64) for z in (x, y)]
    total = 0.0
    for row, count in zip(x, ones[0]):
        common = _POPCOUNT[row & y].sum(axis=1, dtype=np.int64)
        chance, most = count * ones[1] / BITS, np.minimum(count, ones[1])
        total += float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(x)


def fingerprints(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digests(*raw(b.column("text")), ranks), pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def pack(fingerprint: str) -> bytes:
    """Number of features in four bytes, then the filters; half the size of the text."""
    count, _, filters = fingerprint.partition(":")
    return int(count).to_bytes(4, "big") + bytes.fromhex(filters)


def unpacked(packed: Column) -> Column:
    """The text of a packed fingerprint."""
    return F.concat(F.conv(F.hex(F.substring(packed, 1, 4)), 16, 10), F.lit(":"), F.lower(F.hex(F.substring(packed, 5, 2**31 - 1))))


_FOUND = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], prints: list[str], ranks: np.ndarray) -> dict[str, list]:
    """Results of all rows but the last, each against the row behind it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    new = digests(*raw(pa.array(changed, pa.large_string())), ranks) if changed else []
    return {
        "id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": prints[:-1], "edited_fingerprint": new, "near_edited": [likeness(a, b) for a, b in zip(prints, new)],
        "near_next": [likeness(a, b) for a, b in zip(prints, prints[1:])],
    }


def compare_with_next(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to that and to the next row.

    Next is the following row by descending id; the first follows the last.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    edge = f"first_id {kind}, first_text string, first_print string, last_id {kind}, last_text string, last_print string"
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        id_type = text_type = None
        for b in slices(batches, "text"):
            id_type, text_type = b.schema.field("id").type, pa.string()
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, prints = b.column("id").to_pylist(), digests(*raw(b.column("text")), ranks)
            if held:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            first = first or (ids[0], texts[0], prints[0])
            held = (ids[-1], texts[-1], prints[-1])
            out = _compared(ids, texts, prints, ranks)
            for name in ("fingerprint", "edited_fingerprint"):
                out[name] = list(map(pack, out[name]))
            n = len(ids) - 1
            nothing = [pa.nulls(n, t) for t in (id_type, text_type, text_type) * 2]
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], id_type), *(pa.array(out[c]) if n else pa.nulls(0, t) for c, t in zip(names, kinds)), *nothing, pa.array([False] * n, pa.bool_())], columns)
        if first:
            empty = [pa.nulls(1, t) for t in (id_type, *kinds)]
            yield pa.RecordBatch.from_arrays([*empty, *(pa.array([v], t) for v, t in zip((*first, *held), (id_type, text_type, text_type) * 2)), pa.array([True])], columns)

    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    packed = _FOUND.replace("fingerprint string", "fingerprint binary")
    columns = ["id", *names, *(x.split()[0] for x in edge.split(", ")), "edge"]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("id").desc_nulls_last()).sortWithinPartitions(F.col("id").desc_nulls_last(), F.md5("text"))
    found = settle(ordered.mapInArrow(run, f"id {kind}, {packed}, {edge}, edge boolean"))

    # one row per partition: its last row meets the first of the next one
    edges = found.where("edge").select("first_id", "first_text", "first_print", "last_id", "last_text", "last_print")
    order = edges.select("first_id").toPandas()["first_id"].tolist()  # one id per partition
    order.sort(key=lambda x: (x is not None and x == x, x if x is not None and x == x else 0), reverse=True)
    order = [None if x is None or x != x else (int(x) if kind in ("bigint", "int", "smallint", "tinyint") else x) for x in order]
    links = spark.createDataFrame(list(zip(order, [*order[1:], *order[:1]])), f"at {kind}, to {kind}")
    nexts = edges.select(F.col("first_id").alias("next_id"), F.col("first_text").alias("next_text"), F.col("first_print").alias("next_print"))
    met = edges.join(links, F.col("first_id").eqNullSafe(F.col("at"))).join(nexts, F.col("to").eqNullSafe(F.col("next_id")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "last_text"):
            for i, text, own, following, other in zip(*(b.column(c).to_pylist() for c in ("last_id", "last_text", "last_print", "next_text", "next_print"))):
                out = _compared([i, None], [text, following], [own, other], ranks)
                yield pa.RecordBatch.from_arrays([pa.array(out["id"], b.schema.field("last_id").type), *(pa.array(out[c]) for c in names)], ["id", *names])

    last = met.mapInArrow(finish, f"id {kind}, {_FOUND}")
    whole = found.where("not edge").withColumns({c: unpacked(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})
    return whole.select("id", *names).unionByName(last).withColumnRenamed("id", id_col)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compare_with_next(docs, rarity(docs))


QUERIES = {"op5_fingerprints": op5_fingerprints}
