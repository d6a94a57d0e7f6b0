"""Helpers shared by the operators: tables, free column names, a shared folder, text slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lociframe.session import settle

SLICE_BYTES = 4 << 20
# byte sets
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLLOWS = (np.arange(256) & 0xC0) == 0x80  # bytes that continue a code point

__all__ = ["SPACE", "FOLLOWS", "Words", "table", "fresh", "settle", "slices", "raw", "binary_of", "mix64"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to `names` that the frame doesn't have, whatever their case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold `limit` bytes, or are a single row.

    Bounds the arrays a task works on, whatever the number of rows Spark put in a batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = raw(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(where, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def binary_of(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Byte strings from one byte array and n + 1 offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the rows of a slice, as arrays over all rows together."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.rows = data, at, len(at) - 1
        self.space = SPACE[data]
        begins = ~self.space
        begins[1:] &= self.space[:-1]
        edge = at[:-1][at[:-1] < at[1:]]  # first bytes of rows that have any
        begins[edge] = ~self.space[edge]
        self.starts = np.flatnonzero(begins)
        self.before = np.searchsorted(self.starts, at)  # words before each row, n + 1
        self.counts = np.diff(self.before)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def codes(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """Number of each word's spelling, and the spellings."""
        data = self.data[~self.space]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        kept = np.concatenate(([0], np.cumsum(~self.space)))
        found = binary_of(data, np.append(kept[self.starts], len(data))).dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of byte flags in each row."""
        run = np.concatenate(([0], np.cumsum(flags)))
        return run[self.at[1:]] - run[self.at[:-1]]
