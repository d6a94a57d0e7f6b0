"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

1. `vocabulary`: runs of Latin letters of the whole texts, lower-cased, some with a code point
   deleted by a hash rule; counted within slices of a task, then by a partial aggregation.
2. A word is the binary vector of its letters, one dimension for each (letter, how many of it came
   before). A replaced code point flips two dimensions, an inserted or deleted one flips one, so near
   words are vectors at Hamming distance of at most two. `signatures` deals the dimensions to parts
   and enumerates all choices that leave out as many parts as dimensions can differ: near words agree
   on all the others of at least one choice. Nothing is missed.
3. `near_pairs`: the signatures are joined by equality and the edit distance is verified inside the
   join, so that only verified pairs leave it. The one edit lies left or right of the middle, so the
   half that it spares belongs to the join key, as does the length: this divides the anagrams, which
   share all signatures.
4. `forms`: the near word of largest count, if it has at least twice the count of the word; `roots`
   follows forms by doubling the steps, because counts double along a chain at least.

What is joined are distinct words; occurrences, however many, are counted before.

Defined results: null texts and texts without runs have no words; a null id counts as an empty one
in the hash rule; repeated rows are counted each; other columns don't matter; an empty table gives
an empty result. Ties of forms: the smallest word in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import FOLLOWS, binary_of, mix64, raw, settle, slices, table

LEAST_CHARS, LEAST_COUNT = 5, 3
EVERY = 97  # a run in so many loses a code point
#: kind of edit: dimensions that differ at most, parts
KINDS = {"same": (2, 4), "other": (1, 3)}
_LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\xc3", np.uint8))  # C3 leads U+00C0 to U+00FF


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of the spelling of each run, and the spellings, lower-cased."""
    data, at = raw(column)
    member = _LETTER[data]
    member[1:] |= data[:-1] == 0xC3
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    begins[edge] = member[edge]
    starts = np.flatnonzero(begins)
    kept = np.concatenate(([0], np.cumsum(member)))
    lower = np.where((data >= 65) & (data <= 90), data | 32, data)[member]
    found = binary_of(lower, np.append(kept[starts], len(lower))).dictionary_encode()
    return np.searchsorted(at, starts, "right") - 1, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: words of at least `least_chars` code points that occur `least_count` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, code, spellings = runs(b.column("text"))
            if not len(code):
                continue
            words = spellings.to_pylist()
            chars = np.array([len(w.decode()) for w in words])
            long = chars[code] >= least_chars  # a shorter run gives no word, nor does it with a letter less
            pairs, times = np.unique(row[long] * len(words) + code[long], return_counts=True)
            row, code = np.divmod(pairs, len(words))
            heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column("id").to_pylist()]
            h = np.fromiter((zlib.crc32(words[c], heads[r]) for r, c in zip(row.tolist(), code.tolist())), np.int64, len(code))
            hit = h % every == 0
            counts = np.bincount(code[~hit], times[~hit], len(words)).astype(np.int64)
            cut: Counter[str] = Counter()
            for c, place, n in zip(code[hit].tolist(), (h[hit] % chars[code[hit]]).tolist(), times[hit].tolist()):
                if chars[c] > least_chars:
                    text = words[c].decode()
                    cut[text[:place] + text[place + 1 :]] += n
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[c].decode() for c in used.tolist()] + list(cut), pa.string()), pa.array(counts[used].tolist() + list(cut.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def signature_values(words: pa.Array, distance: int, parts: int) -> np.ndarray:
    """A row of 64-bit signatures for each word; words whose letters differ in `distance` dimensions at most share one."""
    data, at = raw(words)
    lead = np.flatnonzero(~FOLLOWS[data])
    point = data[lead].astype(np.int64)
    two = point >= 0xC0  # all code points here are ASCII or of two bytes
    point[two] = (point[two] & 0x1F) << 6 | (data[lead[two] + 1] & 0x3F)
    word = np.searchsorted(at, lead, "right") - 1
    order = np.lexsort((point, word))
    point, word = point[order], word[order]
    place = np.arange(len(point))
    first = np.ones(len(point), bool)
    first[1:] = (point[1:] != point[:-1]) | (word[1:] != word[:-1])
    nth = place - np.maximum.accumulate(np.where(first, place, 0))
    h = mix64((point << 32 | nth + 1).astype(np.uint64))
    sums = np.zeros((len(at) - 1, parts), np.uint64)  # a sum of hashes stands for the set of dimensions of a part
    np.add.at(sums, (word, (h >> np.uint64(40)).astype(np.int64) % parts), mix64(h + np.uint64(1)))
    out = [mix64(sums[:, list(c)].sum(axis=1, dtype=np.uint64) + np.uint64(1000 + k)) for k, c in enumerate(combinations(range(parts), parts - distance))]
    return np.stack(out, axis=1).view(np.int64)


def signatures(words: DataFrame) -> DataFrame:
    """word, n and, for each kind of edit, the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for how in KINDS.values():
                values = signature_values(b.column("word"), *how)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel())))
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), *lists], ["word", "n", *KINDS])

    return words.select("word", "n").mapInArrow(run, f"word string, n long, {', '.join(f'{k} array<long>' for k in KINDS)}")


def _keys(kind: str, shorter: Column) -> Column:
    """Join keys of a word for partners with which the shorter of both has so many code points."""
    middle = F.floor(shorter / 2).cast("int")
    halves = [F.substring("word", F.lit(1), middle), F.substring("word", F.length("word") - (shorter - middle) + 1, shorter - middle)]
    return F.flatten(F.transform(kind, lambda sig: F.array(*[F.xxhash64(F.lit(f"{kind}{i}"), shorter, sig, half) for i, half in enumerate(halves)])))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words one edit apart, once. words: distinct word, n."""
    marked = signatures(words)
    size = F.length("word")

    def side(kind: str, shorter: Column, name: str) -> DataFrame:
        return marked.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.explode(_keys(kind, shorter)).alias("key"))

    near = F.levenshtein("a", "b", 1) == 1
    same = side("same", size, "a").join(side("same", size, "b"), "key").where((F.col("a") < F.col("b")) & near)
    other = side("other", size, "a").join(side("other", size - 1, "b"), "key").where(near)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return same.unionByName(other).select("a", "a_n", "b", "b_n").distinct().select(F.inline(both))


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n."""
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    strong = -F.col("best.minus") >= 2 * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: the last word that forms lead to. links: word, form (null at the ends)."""
    steps = settle(links.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = settle(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    ends = links.select("word").join(steps, "word", "left")
    return ends.select("word", F.coalesce("root", "word").alias("root"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    found = settle(forms(settle(vocabulary(docs, id_col, text_col, least_chars, least_count, every))))
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_variants": op13_variants}
