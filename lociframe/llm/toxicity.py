"""Toxicity by compression distance: how much shorter a window gets with a toxic dictionary.

Two zstandard dictionaries are made from labelled rows: the ordinary one by zstandard's trainer from
windows of ordinary texts, the toxic one of the pieces (runs of letters) that stand in clearly more
toxic rows than ordinary ones by a two-sample test, the most frequent last, where offsets are
shortest. It is kept as a content dictionary, because the trainer's cover drops the rarer pieces.
A window is compressed with the ordinary dictionary alone and with the toxic one behind it, so what
both classes share cancels out, and the gain in bytes is the distance of the window.

The thresholds on the gains (largest, mean, shares and numbers of windows beyond 2, 3 and 5 bytes)
are calibrated by boosted trees, monotone in all of them. For this the labelled rows are cut in two
halves and each is measured with the dictionaries of the other; the final dictionaries come from
both. The score is the calibrated chance of the toxic label.

Windows are pieces of WINDOW bytes or a little more of the lower-cased text, cut where a word
begins; a longer word is cut by length. All windows of all texts are compressed.

Bounded by parameters: the labelled rows that are learned from (`sample_rows`, chosen by a hash of
their id), the pieces (`most_pieces`, the clearest) and
the windows of ordinary rows (about
`train_windows`, by a hash) that reach the driver. Exact copies of a
text count once.

Defined results: null and empty texts and texts of white space have no windows and get the score of
no gain at all; repeated rows and ids are scored one by one; equal texts have equal scores; other
columns don't matter; an empty table gives an empty result; without labels of both kinds every score
is the share of toxic labels, or 0 without any. An id with several labels is toxic if one says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import SPACE, Words, raw, settle, slices, table
from lociframe.llm.quality import Trees, grow

WINDOW = 96
LEAST_TOXIC = 0.7
DICTIONARY_BYTES, TOXIC_BYTES = 112_640, 32_768
LEAST_ROWS, LEAST_Z = 3, 4.0
BEYOND = (2, 3, 5)
STATS = ("largest", "mean", *(f"share{k}" for k in BEYOND), *(f"count{k}" for k in BEYOND), "log_windows")
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{3,40}"
CHUNK = 1 << 16  # windows compressed in one call
_UPPER = np.array([b | 32 if 65 <= b <= 90 else 32 if SPACE[b] else b for b in range(256)], np.uint8)


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, row, start and length of every window. A window holds the space before its first word."""
    data, at = raw(column)
    w = Words(data, at)
    sizes = np.diff(at)
    cuts = np.maximum(-(-sizes // WINDOW) - 1, 0)
    row = np.repeat(np.arange(len(sizes)), cuts)
    mark = at[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts) + 1)
    word = np.append(w.starts, len(data))[np.searchsorted(w.starts, mark)]
    mark = np.where(word < np.minimum(mark + WINDOW, at[row + 1]), word, mark)
    full = np.flatnonzero(w.counts)
    starts = np.concatenate((at[full], mark))
    row = np.concatenate((full, row))
    order = np.argsort(starts, kind="stable")
    starts, row = starts[order], row[order]
    ok = w.counts[row] > 0
    starts, row = starts[ok], row[ok]
    last = np.append(row[1:] != row[:-1], np.ones(min(len(row), 1), bool))
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends[last] = at[row[last] + 1]
    led = (starts > at[row]) & w.space[np.maximum(starts - 1, 0)]
    return _UPPER[data], row, starts - led, ends - starts + led


@dataclass
class Pair:
    """Contents of the two dictionaries."""

    ordinary: bytes
    toxic: bytes
    _tools: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_tools": []}

    def lengths(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Compressed lengths of the windows, a column for each dictionary."""
        if not self._tools:
            how = zstd.ZstdCompressionParameters(
                format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, window_log=18, hash_log=17, chain_log=17, search_log=5,
                min_match=5, target_length=16, strategy=zstd.STRATEGY_GREEDY)
            self._tools += [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how) for content in (self.ordinary, self.ordinary + self.toxic)]
        out = np.empty((len(starts), 2), np.int64)
        for a in range(0, len(starts), CHUNK):
            b = min(a + CHUNK, len(starts))
            low, high = int(starts[a:b].min()), int((starts[a:b] + sizes[a:b]).max())
            part = data[low:high].tobytes()
            places = np.stack((starts[a:b] - low, sizes[a:b]), axis=1).astype("<u8").tobytes()
            for k, tool in enumerate(self._tools):
                found = tool.multi_compress_to_buffer(zstd.BufferWithSegments(part, places), threads=1)
                out[a:b, k] = np.fromiter((len(found[i]) for i in range(b - a)), np.int64, b - a)
        return out

    def measure(self, column: pa.Array) -> np.ndarray:
        """STATS of the texts, a row each."""
        data, row, starts, sizes = windows(column)
        out = np.zeros((len(column), len(STATS)))
        if not len(row):
            return out
        found = self.lengths(data, starts, sizes)
        gain = (found[:, 0] - found[:, 1]).astype(float)
        n = np.bincount(row, minlength=len(column))
        has = np.flatnonzero(n)
        out[has, 0] = np.maximum.reduceat(gain, np.append(0, np.cumsum(n[has]))[:-1])
        out[:, 1] = np.bincount(row, gain, len(column)) / np.maximum(n, 1)
        for k, least in enumerate(BEYOND):
            count = np.bincount(row, gain >= least, len(column))
            out[:, 2 + k] = count / np.maximum(n, 1)
            out[:, 2 + len(BEYOND) + k] = count
        out[:, -1] = np.log1p(n)
        return out


@dataclass
class Model:
    pair: Pair
    trees: Trees

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-self.trees.score(self.pair.measure(column))))


def ordinary_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained by zstandard; what the trainer can't use, because it is too little, is the dictionary itself."""
    try:
        return zstd.train_dictionary(size, samples, k=50, d=8).as_bytes()
    except (zstd.ZstdError, ValueError):
        return (b"".join(samples) or b" " * 8)[-size:]


def toxic_dictionary(pieces: list[tuple[str, int]], size: int = TOXIC_BYTES) -> bytes:
    """Pieces with their numbers of rows, the most frequent last."""
    return b" ".join([b"", *(p.encode() for p, _ in sorted(pieces, key=lambda x: (x[1], x[0]))), b""])[-size:]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, sample_rows: int) -> DataFrame:
    """key, text, label and half of the labelled texts that are learned from: `sample_rows` at most."""
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    picked = F.broadcast(one.orderBy(F.xxhash64("id"), "id").limit(sample_rows))  # bounded by sample_rows
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).join(picked, F.col("doc") == F.col("id"))
    once = rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    return once.where("text is not null").withColumn("half", F.pmod(F.crc32("key"), F.lit(2)).cast("int"))


def _pieces(rows: DataFrame, most: int) -> list:
    """Pieces with the numbers of toxic and ordinary rows of each half that hold them, the clearest ones of each choice of halves."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = [F.sum(F.when((F.col("half") == h) & (F.col("label") == y), 1).otherwise(0)).alias(f"c{h}{y}") for h in (0, 1) for y in (0, 1)]
    totals = rows.agg(*of).first()
    found = rows.select("half", "label", F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(PIECE), F.lit(0)))).alias("piece")).where("octet_length(piece) >= 4")
    found = found.groupBy("piece").agg(*of).where(f"c01 + c11 >= {LEAST_ROWS}")

    def clear(halves: tuple[int, ...]):
        ordinary, toxic = (sum(F.col(f"c{h}{y}") for h in halves) for y in (0, 1))
        n0, n1 = (max(sum((totals[f"c{h}{y}"] or 0) for h in halves), 1) for y in (0, 1))
        p = (ordinary + toxic) / (n0 + n1)
        z = (toxic / n1 - ordinary / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n0 + 1 / n1))
        return F.when(toxic >= LEAST_ROWS, z)

    columns = {"z0": (0,), "z1": (1,), "z": (0, 1)}
    scored = found.select("*", *[clear(h).alias(c) for c, h in columns.items()]).where(" or ".join(f"{c} >= {LEAST_Z}" for c in columns))
    return scored.orderBy(F.greatest(*columns).desc(), "piece").limit(most).collect()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample_rows: int = 20_000, most_pieces: int = 4000, train_windows: int = 100_000) -> Model:
    """Learn dictionaries and thresholds from a bounded sample of the labelled rows."""
    rows = settle(sample(docs, labels, id_col, text_col, label, sample_rows))
    pieces = _pieces(rows, most_pieces)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, row, starts, sizes = windows(b.column("text"))
            whole = data.tobytes()
            found = [whole[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("half").take(pa.array(row)), pa.array(found, pa.binary())], ["half", "window"])

    found = settle(rows.where("label = 0").select("half", "text").mapInArrow(cut, "half int, window binary").distinct())
    # a share of them by a hash, instead of an ordered limit, to which every task would send as many
    share = min(train_windows / max(found.count(), 1), 1.0)
    samples = found.where(F.pmod(F.xxhash64("window"), F.lit(1 << 20)) < round(share * (1 << 20))).collect()
    samples.sort(key=lambda r: (bytes(r.window), r.half))

    def pair(halves: tuple[int, ...], z: str) -> Pair:
        chosen = [(r.piece, sum(r[f"c{h}1"] for h in halves)) for r in pieces if r[z] is not None and r[z] >= LEAST_Z]
        return Pair(ordinary_dictionary([bytes(r.window) for r in samples if r.half in halves]), toxic_dictionary(chosen))

    halves = [pair((1,), "z1"), pair((0,), "z0")]  # each half is measured with the other one's

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            half = b.column("half").to_numpy()
            for h in (0, 1):
                part = b.filter(pa.array(half == h))
                x = halves[h].measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), *(pa.array(c) for c in x.T)], ["key", "label", *STATS])

    measured = rows.mapInArrow(measure, f"key string, label int, {', '.join(f'{s} double' for s in STATS)}").toPandas().sort_values("key")
    signs = np.array([0 if s == "log_windows" else 1 for s in STATS])
    trees = grow(measured[list(STATS)].to_numpy(float), measured["label"].to_numpy(float), signs, n_trees=80, depth=2, rate=0.1)
    if not len(measured):
        trees.start = -40.0  # nothing is known to be toxic
    return Model(pair((0, 1), "z"), trees)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_TOXIC) -> DataFrame:
    """id, score and predicted of every row; nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = model.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p), pa.array((p >= least).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op12_toxicity": op12_toxicity}
