"""Edit-aware token counts: a segment tree of pieces per document, updated where edits touch it.

`build` cuts every text into pieces once and keeps, per document, two trees of sums in one layout:
code points and tokens. Level 0 has one slot per piece, every next level the sums of pairs, down to
one root, which is the count. The trees are columns, so they can be stored and edited by later jobs.

`apply` splices edits. A slot begins at a piece boundary, and what the split pattern finds from a
boundary on depends on nothing before it. So a splice walks down to the slot that holds the third
code point before the edit (no piece looks further ahead than that), cuts pieces from there, and
stops at the first boundary behind the edit that an old slot shares. Only these pieces are encoded;
their counts replace those of the slots between (a surplus shares the last slot), and the sums above
are renewed.

Nothing is shuffled: edits are a column of the same row. Defined results: null and empty texts have
one empty slot; edits count code points of the text as it is, are clipped to its ends, and are
applied from the last to the first by (start, stop, text); null edits, null parts of an edit and an
empty list change nothing (a null replacement is empty); a stop before its start inserts at the
start; other columns stay, and those named like a result column are replaced; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.bpe import LONG_FORMS, SHORT_FORMS, SP, TEXT_SLICE, WS, Merger, classes, default_ranks, merger, pieces, spread
from lociframe.llm.common import binary_of, slices, table

LOOK = 3  # code points that a piece can depend on behind its end, and itself
EDITS = "array<struct<start:int,stop:int,text:string>>"


def levels(n: int) -> list[int]:
    """Sizes of the levels over n slots."""
    out = [n]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out


def plant(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trees of all rows one after another, from their slots' values; and where each begins."""
    sizes = np.diff(at)
    total, n, begins = np.zeros(len(sizes), np.int64), sizes.copy(), []
    while True:
        begins.append(total.copy())
        total += n
        if not (n > 1).any():
            break
        n = np.where(n > 1, (n + 1) // 2, 0)
    base = np.append(0, np.cumsum(total))
    out = np.zeros(int(base[-1]), np.int64)
    level, n = values, sizes
    for k, inner in enumerate(begins):
        out[spread(base[:-1] + inner, n)] = level
        if k + 1 < len(begins):
            up = np.where(n > 1, (n + 1) // 2, 0)
            first = np.append(0, np.cumsum(n))[:-1]
            left = np.repeat(first, up) + 2 * (np.arange(int(up.sum())) - np.repeat(np.append(0, np.cumsum(up))[:-1], up))
            has = left + 1 < np.repeat(first + n, up)
            level = level[left] + np.where(has, level[np.minimum(left + 1, len(level) - 1)], 0) if len(left) else level[:0]
            n = up
    return out, base


def piece_end(text: str, i: int) -> int:
    """End of the piece that begins at code point i."""
    kinds, n = classes(), len(text)
    if text[i] == "'":
        if text[i + 1 : i + 2] and text[i + 1] in SHORT_FORMS:
            return i + 2
        if text[i + 1 : i + 3] in LONG_FORMS:
            return i + 3
    j = i
    kind = kinds[ord(text[j])]
    if kind == SP and j + 1 < n and kinds[ord(text[j + 1])] not in (SP, WS):
        j += 1
        kind = kinds[ord(text[j])]
    if kind in (SP, WS):
        while j < n and kinds[ord(text[j])] in (SP, WS):
            j += 1
        return j if j == n or j == i + 1 else j - 1
    while j < n and kinds[ord(text[j])] == kind:
        j += 1
    return j


class Tree:
    """One document's two trees of sums."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, slots: int):
        self.text, cuts = text, np.append(0, np.cumsum(levels(slots)))
        self.flat = (chars, tokens)
        self.chars, self.tokens = ([x[a:b] for a, b in zip(cuts[:-1], cuts[1:])] for x in self.flat)
        self.encoded = 0

    @property
    def count(self) -> int:
        return int(self.tokens[-1][0])

    def find(self, position: int) -> tuple[int, int]:
        """Slot that holds a code point, and where the slot begins."""
        slot = begin = 0
        for level in reversed(self.chars[:-1]):
            slot *= 2
            if slot + 1 < len(level) and position >= begin + level[slot]:
                begin += int(level[slot])
                slot += 1
        return slot, begin

    def splice(self, start: int, stop: int, new: str, how: Merger) -> None:
        """Replace the code points from start to stop by new and renew what that touches."""
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        text = self.text = self.text[:start] + new + self.text[stop:]
        shift = len(new) - (stop - start)
        first, at = self.find(min(max(start - LOOK, 0), max(n - 1, 0)))
        slots = self.chars[0]
        # old slots from first up to end_slot, at old_end, are given up
        end_slot, old_end, found, begin = first + 1, at + int(slots[first]), [], at
        while True:
            while end_slot < len(slots) and (old_end < stop or old_end + shift < at):
                old_end += int(slots[end_slot])
                end_slot += 1
            if (at >= start + len(new) and old_end + shift == at and old_end >= stop) or at >= len(text):
                break
            at = piece_end(text, at)
            found.append(text[begin:at])
            begin = at
        if at >= len(text):
            end_slot = len(slots)
        while end_slot < len(slots) and not slots[end_slot]:
            end_slot += 1  # empty slots have room
        sizes = [len(x.encode()) for x in found]
        kinds = list(dict.fromkeys(x.encode() for x in found))
        counts = dict(zip(kinds, map(len, how.ids(kinds))))
        made = [(len(x), counts[x.encode()]) for x in found]
        self.encoded += len(sizes)
        room = end_slot - first
        if len(made) > room:
            rest = made[room - 1 :]
            made = [*made[: room - 1], (sum(c for c, _ in rest), sum(t for _, t in rest))]
        made += [(0, 0)] * (room - len(made))
        for level, values in ((self.chars, [c for c, _ in made]), (self.tokens, [t for _, t in made])):
            level[0][first:end_slot] = values
            a, b = first, end_slot
            for below, above in zip(level, level[1:]):
                a, b = a // 2, (b + 1) // 2
                pair = below[2 * a : 2 * b]
                above[a:b] = pair[::2]
                above[a : a + len(pair) // 2] += pair[1::2]


def build(docs: DataFrame, ranks: str, text_col: str = "text") -> DataFrame:
    """Add n_tokens, slots, tree_chars and tree_tokens to every row."""
    new = ("n_tokens", "slots", "tree_chars", "tree_tokens")
    keep = [c for c in docs.columns if c.lower() not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = merger(ranks)
        for b in slices(batches, text_col, TEXT_SLICE):
            data, begins, piece_at, at = pieces(b.column(text_col))
            found = binary_of(data, begins).dictionary_encode()
            lengths = np.fromiter(map(len, how.ids(found.dictionary.to_pylist())), np.int64, len(found.dictionary))
            counts = lengths[found.indices.to_numpy(zero_copy_only=False)]
            lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            chars = np.diff(lead[begins])
            empty = np.flatnonzero(np.diff(piece_at) == 0)  # one empty slot each
            chars, counts = np.insert(chars, piece_at[empty], 0), np.insert(counts, piece_at[empty], 0)
            slot_at = piece_at + np.append(0, np.cumsum(np.diff(piece_at) == 0))
            (c, base), (t, _) = plant(chars, slot_at), plant(counts, slot_at)
            roots = t[base[1:] - 1] if len(base) > 1 else t
            lists = [pa.ListArray.from_arrays(pa.array(base, pa.int32()), pa.array(x, pa.int32())) for x in (c, t)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(roots), pa.array(np.diff(slot_at), pa.int32()), *lists], [*keep, *new])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema)
    return source.mapInArrow(run, f"{schema}n_tokens long, slots int, tree_chars array<int>, tree_tokens array<int>")


def apply(trees: DataFrame, edits_col: str, ranks: str, text_col: str = "text", keep_trees: bool = True) -> DataFrame:
    """Apply each row's edits: new text, count and trees; n_tokens_before and n_encoded (pieces encoded anew)."""
    drop = {"n_tokens_before", "n_encoded"} | (set() if keep_trees else {"slots", "tree_chars", "tree_tokens", text_col.lower()})
    keep = [c for c in trees.columns if c.lower() not in drop and c != edits_col]
    source = trees.withColumn(edits_col, F.col(edits_col).cast(EDITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = merger(ranks)
        for b in slices(batches, text_col, TEXT_SLICE):
            texts, before, after, encoded, shapes = [], [], [], [], ([], [])
            for text, slots, edits, chars, tokens in zip(b.column(text_col).to_pylist(), b.column("slots").to_pylist(), b.column(edits_col).to_pylist(), b.column("tree_chars"), b.column("tree_tokens")):
                tree = Tree(text or "", *(np.array(x.values.to_numpy(), np.int64) for x in (chars, tokens)), slots)
                before.append(tree.count)
                whole = [(e["start"], e["stop"], e["text"] or "") for e in edits or [] if e and e["start"] is not None and e["stop"] is not None]
                for start, stop, new in sorted(whole, reverse=True):
                    tree.splice(start, stop, new, how)
                after.append(tree.count)
                encoded.append(tree.encoded)
                texts.append(tree.text if text is not None or tree.text else None)
                if keep_trees:
                    for held, flat in zip(shapes, tree.flat):
                        held.append(flat)
            new = {text_col: pa.array(texts, pa.string()), "n_tokens": pa.array(after, pa.int64())}
            if keep_trees:
                at = np.append(0, np.cumsum([len(x) for x in shapes[0]]))
                new |= {k: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(x), pa.int32())) for k, x in zip(("tree_chars", "tree_tokens"), shapes)}
            yield pa.RecordBatch.from_arrays([*(new.get(k, b.column(k) if k not in new else None) for k in keep), pa.array(before, pa.int64()), pa.array(encoded, pa.int64())], [*keep, "n_tokens_before", "n_encoded"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name in keep)
    return source.mapInArrow(run, f"{schema}n_tokens_before long, n_encoded long")


def sample_edits(text: str = "text") -> Column:
    """Three edits of every text: its source set into the first third, five code points cut, a note at the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    third = F.floor(n / 3).cast("int")
    edit = lambda start, stop, new: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), new.alias("text"))
    return F.array(
        edit(third, third + 8, F.concat(F.lit("'"), F.coalesce("source", F.lit("")))), edit(2 * third, 2 * third + 5, F.lit("")),
        edit(n, n, F.concat(F.lit(" "), F.coalesce("lang", F.lit("")))))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", sample_edits().alias("edits"))
    ranks = default_ranks()
    return apply(build(docs, ranks), "edits", ranks, keep_trees=False).select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), "n_encoded")


QUERIES = {"op8_token_counts": op8_token_counts}
