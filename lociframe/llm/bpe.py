"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pieces that the split pattern of the rank files would match are found without a regular
expression. Every code point gets a class (letter, number, other, blank, other white space,
apostrophe that opens a contraction); every class is a function between nine scanner states. Such
functions compose associatively into a small monoid, so a blocked prefix scan over composition
numbers gives the state before and after every code point of many texts at once; whether a piece
begins follows from those two states and, inside white space, from the class that comes next.

Pieces are slices of the byte array. Equal slices are numbered together, each spelling is merged
once and remembered in a cache of bounded size, and the ids are spread back by array indexing.
`encode` keeps the byte offset of every token; `decode` turns ids to bytes and checks the offsets.

Nothing is shuffled; a task holds one slice of texts (1 MB, or one longer text). Defined results:
null and empty texts have no tokens and decode to empty; malformed UTF-8 is read with U+FFFD in its
place; other columns stay, and one named like a result column is replaced; empty tables give empty
results.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import FOLLOWS, binary_of, raw, slices, table

# scanner states: what the last code point belongs to
START, LETTERS, NUMBERS, OTHERS, BLANK, WHITE, TWO_LEFT, ONE_LEFT, CLOSED = range(9)
# classes of code points; SHORT and LONG are apostrophes followed by one or two fitting letters
LETTER, NUMBER, OTHER, SP, WS, SHORT, LONG = range(7)
CLASSES = 7
# fixed values: white space of the split pattern, and its contractions
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_FORMS = "stmd"
LONG_FORMS = ("re", "ve", "ll")
MAX_CACHED = 60_000
TEXT_SLICE, TOKEN_SLICE = 1 << 20, 1 << 18  # bytes encoded and tokens decoded at a time
FEW = 64  # pieces from which merging in step pays
LONG_PIECE = 256  # bytes; longer pieces are merged one by one with a heap
NONE = np.int64(1 << 40)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WS
    out[0x20] = SP
    return out


def step(state: int, kind: int) -> int:
    """State after a code point of a class."""
    if kind == LETTER:
        return {TWO_LEFT: ONE_LEFT, ONE_LEFT: CLOSED}.get(state, LETTERS)
    if kind in (SHORT, LONG):  # after a blank or another mark the apostrophe is an ordinary mark
        return OTHERS if state in (BLANK, OTHERS) else ONE_LEFT if kind == SHORT else TWO_LEFT
    return {NUMBER: NUMBERS, OTHER: OTHERS, SP: BLANK, WS: WHITE}[kind]


def _begins(state: int, kind: int) -> bool:
    """Whether a piece begins at a code point of a class after a state; white space runs aside."""
    after = step(state, kind)
    if kind == LETTER:
        return after == LETTERS and state not in (LETTERS, BLANK)
    if after in (NUMBERS, OTHERS):
        return state not in (after, BLANK)
    return kind in (SHORT, LONG) or state not in (BLANK, WHITE)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the class functions.

    Returns the number of each generator (the classes, then the classes at the start of a row, which
    forget the state), the composition table, the image of every state, and the table of beginnings.
    """
    gens = [tuple(step(s, k) for s in range(9)) for k in range(CLASSES)]
    gens += [(step(START, k),) * 9 for k in range(CLASSES)]
    known = {tuple(range(9)): 0}
    todo = [*known]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    funcs = list(known)
    table_ = np.array([[known[tuple(g[x] for x in f)] for g in funcs] for f in funcs], np.uint16)
    begins = np.array([[_begins(s, k) for k in range(CLASSES)] for s in range(9)])
    return np.array([known[g] for g in gens], np.uint16), table_, np.array(funcs, np.uint8), begins


def scan(codes: np.ndarray) -> np.ndarray:
    """Prefix compositions of function numbers: blocks side by side, then the blocks' totals."""
    _, compose, _, _ = monoid()
    flat, m, n = compose.ravel(), len(compose), len(codes)
    if n <= 32:
        out = codes.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    width = int(np.ceil(np.sqrt(n)))
    count = -(-n // width)
    grid = np.zeros(width * count, np.uint16)  # 0 is the identity
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(count, width).T)
    for j in range(1, width):
        grid[j] = flat[grid[j - 1].astype(np.int32) * m + grid[j]]
    ahead = np.zeros(count, np.uint16)
    ahead[1:] = scan(grid[-1])[:-1]
    return flat[ahead.astype(np.int32) * m + grid].T.ravel()[:n]


def piece_starts(points: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Indices of the code points at which a piece begins.

    points: code points of all rows; row_at: index of each row's first, and the total.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    gens, _, image, begins = monoid()
    kind = classes()[points]
    first = np.zeros(n, bool)
    heads = row_at[:-1][row_at[:-1] < row_at[1:]]
    first[heads] = True
    # letters that follow in the same row, 0 where the row ends
    after = np.zeros(n + 2, points.dtype)
    after[:n] = points
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        end = row_at[np.searchsorted(row_at, marks, "right")]
        one = np.where(marks + 1 < end, after[marks + 1], 0)
        two = np.where(marks + 2 < end, after[marks + 2], 0)
        short = np.isin(one, [ord(c) for c in SHORT_FORMS])
        long = np.zeros(len(marks), bool)
        for form in LONG_FORMS:
            long |= (one == ord(form[0])) & (two == ord(form[1]))
        kind[marks[long]] = LONG
        kind[marks[short]] = SHORT
    state = image[scan(gens[kind + CLASSES * first]), START]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = START, state[:-1]
    before[first] = START
    out = begins[before, kind]
    # inside white space a piece begins at the last blank if a visible code point follows
    white = (kind == SP) | (kind == WS)
    inner = np.flatnonzero(white[1:] & white[:-1] & ~first[1:]) + 1
    inner = inner[inner + 1 < n]
    out[inner[~white[inner + 1] & ~first[inner + 1]]] = True
    out[first] = True
    return np.flatnonzero(out)


class Merger:
    """Merges of one rank file, with a cache of merged spellings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.single_ids = np.array(self.single, np.int64)
        order = sorted(self.pairs)
        self.keys = np.array(order or [-1], np.int64)
        self.joined = np.array([self.pairs[k] for k in order] or [NONE], np.int64)
        self.byte_pairs = self.rank_of(*(x.ravel() for x in np.meshgrid(self.single_ids, self.single_ids, indexing="ij"))).reshape(256, 256)
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}
        self.sizes = np.fromiter(map(len, self.vocab), np.int64, len(self.vocab))

    def ids(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct pieces; at most 2 * MAX_CACHED spellings are remembered."""
        young, old, whole = self.young, self.old, self.ranks
        out = [young.get(p) or old.get(p) or ((whole[p],) if p in whole else None) for p in pieces]
        missing = [i for i, found in enumerate(out) if found is None]
        short = [i for i in missing if len(pieces[i]) <= LONG_PIECE]
        if len(short) > FEW:
            for i, found in zip(short, self.merge([pieces[i] for i in short])):
                out[i] = found
        for i in missing:
            if out[i] is None:
                out[i] = tuple(self.merge_long([self.single[b] for b in pieces[i]]))
            if len(pieces[i]) <= 64:
                young[pieces[i]] = out[i]
        if len(young) >= MAX_CACHED:
            self.old, self.young = young, {}
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined token of each pair, NONE if there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Join neighbours, lowest rank first, leftmost first among equals; all pieces in step.

        Each round joins one pair of every piece that still has one and looks up only the two pairs
        that this changes.
        """
        if not pieces:
            return []
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids, who = self.single_ids[data], np.arange(len(pieces))
        rank = np.full(len(data), NONE)
        rank[:-1] = self.byte_pairs[data[:-1], data[1:]]
        rank[np.cumsum(size) - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, size)
                done.append((who[over], size[over], ids[gone]))
                ids, rank, who, size, best = ids[~gone], rank[~gone], who[~over], size[~over], best[~over]
                if not len(who):
                    break
                starts = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(who)), size)
            hits = np.flatnonzero(rank == best[owner])
            at = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]
            ids[at] = best
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, rank, size = ids[left], rank[left], size - 1
            at, starts = at - np.arange(len(at)), starts - np.arange(len(at))
            last = at == starts + size - 1
            after = np.minimum(at + 1, len(ids) - 1)
            rank[at] = np.where(last, NONE, self.rank_of(ids[at], ids[after]))
            inner = at[at > starts]
            rank[inner - 1] = self.rank_of(ids[inner - 1], ids[inner])
        out: list[tuple[int, ...]] = [()] * len(pieces)
        for owners, sizes, flat in done:
            values, ends = flat.tolist(), np.cumsum(sizes).tolist()
            for w, a, b in zip(owners.tolist(), [0, *ends], ends):
                out[w] = tuple(values[a:b])
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for long pieces: a heap of pairs over a linked list."""
        n, get = len(ids), self.pairs.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := get(rank << 20 | ids[right[i]])) is not None:
                    heappush(heap, (r, i))
            if left[i] >= 0 and (r := get(ids[left[i]] << 20 | rank)) is not None:
                heappush(heap, (r, left[i]))
        return [x for x in ids if x >= 0]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(2)
def merger(path: str) -> Merger:
    """Rank file at a local path, read once per Python worker."""
    return Merger(read_ranks(path))


@lru_cache(2)
def vocabulary(path: str) -> pa.Array:
    """Bytes of every id, all that decoding needs."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def clean(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets and code points of a text column."""
    data, at = raw(column)
    try:
        text = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        data, at = raw(pa.array(rows, pa.large_string()))
        text = "".join(rows)
    return data, at, np.frombuffer(text.encode("utf-32-le"), np.uint32)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + counts[i] - 1 for all i, one after another."""
    total = np.cumsum(counts)
    return np.repeat(starts - np.append(0, total[:-1]), counts) + np.arange(total[-1] if len(total) else 0)


def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a slice, byte offset of every piece (and the end), pieces before each row (n + 1), row offsets."""
    data, at, points = clean(column)
    byte_of = np.flatnonzero(~FOLLOWS[data])  # of each code point
    begins = byte_of[piece_starts(points, np.searchsorted(byte_of, at))]
    return data, np.append(begins, len(data)), np.searchsorted(begins, at), at


def encode_column(column: pa.Array, how: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all rows, tokens before each row (n + 1), byte offset of each token in its row."""
    data, begins, piece_at, at = pieces(column)
    found = binary_of(data, begins).dictionary_encode()
    ids = how.ids(found.dictionary.to_pylist())
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for p in ids for i in p), np.int64, int(lengths.sum()))
    which = found.indices.to_numpy(zero_copy_only=False)
    counts = lengths[which]
    tokens = flat[spread((np.cumsum(lengths) - lengths)[which], counts)]
    token_at = np.append(0, np.cumsum(counts))[piece_at]
    size = how.sizes[tokens]
    ends = np.cumsum(size)
    return tokens, token_at, ends - size - np.repeat(at[:-1], np.diff(token_at))


def default_ranks() -> str:
    """The installed rank file for many languages; its path is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _without(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def encode(docs: DataFrame, ranks: str, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add token_ids and token_starts (byte offset of each token in its text) to every row."""
    keep = [c for c in docs.columns if c not in drop and c.lower() not in ("token_ids", "token_starts")]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = merger(ranks)
        for b in slices(batches, text_col, TEXT_SLICE):
            tokens, token_at, starts = encode_column(b.column(text_col), how)
            at = pa.array(token_at, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (tokens, starts)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *lists], [*keep, "token_ids", "token_starts"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name in keep)
    return source.mapInArrow(run, f"{schema}token_ids array<int>, token_starts array<int>")


def token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches at TOKEN_SLICE tokens, or after a single row."""
    for batch in batches:
        ends, start = batch.column("token_ids").offsets.to_numpy(), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + TOKEN_SLICE, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """Add `decoded`, the bytes of token_ids; offsets in token_starts that don't fit raise an error."""
    source = _without(tokens, ("decoded",))
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks)
        for b in token_slices(batches):
            ids, starts = b.column("token_ids"), b.column("token_starts")
            at = ids.offsets.to_numpy()
            out = vocab.take(ids.flatten())
            data, ends = raw(out)
            row_ends = ends[at - at[0]]
            if (np.repeat(row_ends[:-1], np.diff(at)) + starts.flatten().to_numpy() != ends[:-1]).any():
                raise ValueError("token_starts do not belong to these token_ids")
            yield pa.RecordBatch.from_arrays([*b.columns, binary_of(data, row_ends).cast(pa.binary())], [*names, "decoded"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema)
    return source.mapInArrow(run, f"{schema}decoded binary")


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the decoded bytes of every row."""
    tokens = decode(encode(docs.select("doc_id", "text"), ranks, drop=("text",)), ranks)
    listed = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return tokens.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_ranks())


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
