"""Ranked lexical search over a length-stratified index.

`index` turns every document into one row of term hashes and occurrences, in order of its length
inside each partition and kept in the shared folder. The normaliser m depends on the length alone,
so documents of equal m lie together: a stratum of that partition. Nothing is shuffled, and a
stratum that holds a third of all documents is spread like the documents themselves.

`search` takes the items in blocks of a bounded number of terms. Per block it counts in how many
documents each term stands, then one pass over the index ranks: a task inverts a batch of the index
to postings in order of term, stratum and falling tf, computes one impact for each tf of a stratum,
and adds up for every item the largest impacts to a bound of each stratum. It visits the strata by
falling bound, in waves that double, until no bound reaches the item's worst kept score, which it
carries on to the next batches. Bounds are sums of exact integers, so nothing that ranks is left
out. A task returns `top` documents for an item at most; two rankings, of which the first is spread
by a hash, unite them.

Terms are known by 64 bits of hash: a term of a query meets another one of the corpus with a chance
of 1 to 2**64 for each pair of terms.

Defined results: null and empty texts hold no terms and are never ranked; rows that repeat an id are
documents of their own; a null document id comes last among equal scores; items that share an id are
one item with the terms of all; items without known terms have no rows; other columns don't matter;
without documents or items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lociframe.llm.common import binary_of, raw, settle, slices, table

TOP = 50
BLOCK_TERMS = 1 << 18  # terms of all items that a task holds at once, unless a single item has more
SPREAD = 64  # buckets of the first ranking
_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def count_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with repeats of each row; row, hash and occurrences of its distinct terms, in order of rows."""
    data, at = raw(column)
    member = _TERM[data]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    begins[edge] = member[edge]
    starts = np.flatnonzero(begins)
    kept = np.concatenate(([0], np.cumsum(member)))
    lower = np.where((data >= 65) & (data <= 90), data | 32, data)[member]
    found = binary_of(lower, np.append(kept[starts], len(lower))).dictionary_encode()
    hashes = np.fromiter(map(xxh3_64_intdigest, found.dictionary.to_pylist()), np.uint64, len(found.dictionary)).view(np.int64)
    row = np.searchsorted(at, starts, "right") - 1
    pairs, tf = np.unique(row * max(len(hashes), 1) + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
    rows, code = np.divmod(pairs, max(len(hashes), 1))
    return np.bincount(row, minlength=len(at) - 1), rows, hashes[code], tf


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, rows, hashes, tf = count_terms(b.column("text"))
            ends = np.searchsorted(rows, np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))], ["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, terms array<long>, tfs array<int>")


@dataclass
class Index:
    """rows: id, n, terms and tfs of every document with terms, by n inside a partition; documents and terms in all."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    rows = settle(_counted(docs, id_col, text_col).where("n > 0").sortWithinPartitions("n"))
    total = rows.agg(F.count("*"), F.sum("n")).first()
    return Index(rows, total[0], total[1] or 0)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of terms that stand in df documents."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


@dataclass
class Block:
    """Items with their terms as places in a sorted vocabulary; at has n + 1 offsets into terms."""

    items: list
    vocabulary: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    weight: np.ndarray | None = None

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the vocabulary, and the places of those."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == hashes
        return hit, place[hit]


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items, about `block_terms` terms at a time: all rows of an item fall into one block."""
    found = settle(_counted(items, id_col, text_col).where("n > 0").select("id", "terms"))
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = -(-total // block_terms)
    for k in range(n):
        of: dict = {}
        for r in found.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).toLocalIterator():
            of.setdefault(r.id, set()).update(r.terms)
        if of:
            lists = [np.array(sorted(t), np.int64) for t in of.values()]
            vocabulary = np.unique(np.concatenate(lists))
            yield Block(list(of), vocabulary, np.searchsorted(vocabulary, np.concatenate(lists)), np.append(0, np.cumsum([len(t) for t in lists])))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the n + 1 offsets of its rows."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def document_counts(found: Index, block: Block) -> np.ndarray:
    """Documents that hold each term of the block's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block.vocabulary), np.int64)
        for b in batches:
            df += np.bincount(block.places(_flat(b.column("terms"))[0])[1], minlength=len(df))
        place = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(df[place])], ["place", "df"])

    out = np.zeros(len(block.vocabulary), np.int64)
    for r in found.rows.select("terms").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.place] = r.df
    return out


class Strata:
    """A batch of the index, inverted for the terms of a block."""

    def __init__(self, block: Block, n: np.ndarray, hashes: np.ndarray, at: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int):
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        self.m, self.of_doc, self.sizes = np.unique(m, return_inverse=True, return_counts=True)
        hit, term = block.places(hashes)
        doc, tf = np.repeat(np.arange(len(n)), np.diff(at))[hit], tfs[hit].astype(np.int64)
        stratum = self.of_doc[doc]
        order = np.lexsort((-tf, stratum, term))
        self.doc, self.stratum, term, tf = doc[order], stratum[order], term[order], tf[order]
        # one impact for each tf of a term in a stratum
        head = np.ones(len(term), bool)
        new = (term[1:] != term[:-1]) | (self.stratum[1:] != self.stratum[:-1])
        head[1:] = new | (tf[1:] != tf[:-1])
        t = tf[head]
        impact = (1_000_000_000 * t) // (1000 * t + 20 * self.m[self.stratum[head]])
        self.impact = impact[np.cumsum(head) - 1]
        places = np.arange(len(block.vocabulary) + 1)
        self.at = np.searchsorted(term, places)  # postings of each term
        largest = np.flatnonzero(np.append(True, new)[: len(term)])  # tf falls, so the first impact is the largest
        self.top_stratum, self.top_impact, self.top_at = self.stratum[largest], self.impact[largest], np.searchsorted(term[largest], places)

    def bounds(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """No document of a stratum scores more."""
        out = np.zeros(len(self.m), np.int64)
        for t, w in zip(terms.tolist(), weight.tolist()):
            a, b = self.top_at[t], self.top_at[t + 1]
            out[self.top_stratum[a:b]] += w * self.top_impact[a:b]  # a term has one entry in a stratum
        return out

    def scores(self, terms: np.ndarray, weight: np.ndarray, visited: np.ndarray) -> np.ndarray:
        """Scores of the documents in the visited strata, 0 elsewhere."""
        out = np.zeros(len(self.of_doc), np.int64)
        for t, w in zip(terms.tolist(), weight.tolist()):
            a, b = self.at[t], self.at[t + 1]
            out[self.doc[a:b]] += w * self.impact[a:b]  # a term has one posting for a document
        out[~visited[self.of_doc]] = 0
        return out


class Best:
    """The best `top` documents of one item so far; ties by id, a null id last."""

    def __init__(self, top: int):
        self.top, self.score, self.null, self.id = top, np.zeros(0, np.int64), np.zeros(0, bool), None

    @property
    def least(self) -> int:
        """A score that a document has to reach to be kept."""
        return max(int(self.score[-1]), 1) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        self.score, self.null = np.append(self.score, score), np.append(self.null, null)
        self.id = ids if self.id is None else np.append(self.id, ids)
        order = np.lexsort((self.id, self.null, -self.score))[: self.top]
        self.score, self.null, self.id = self.score[order], self.null[order], self.id[order]


def _visit(strata: Strata, block: Block, item: int, best: Best, ids: np.ndarray, null: np.ndarray) -> None:
    terms = block.terms[block.at[item] : block.at[item + 1]]
    weight = block.weight[terms]
    bounds = strata.bounds(terms, weight)
    order = np.argsort(-bounds, kind="stable")
    ends = np.cumsum(strata.sizes[order])
    start, wave = 0, 4 * best.top
    while start < len(order) and bounds[order[start]] >= best.least:
        stop = max(int(np.searchsorted(ends, wave)) + 1, start + 1)
        reach = int(np.searchsorted(-bounds[order], -best.least, "right"))  # bounds from the worst kept score up
        stop = min(stop, reach)
        visited = np.zeros(len(order), bool)
        visited[order[start:stop]] = True
        scores = strata.scores(terms, weight, visited)
        found = np.flatnonzero(scores >= best.least)
        best.add(scores[found], null[found], ids[found])
        start, wave = stop, wave * 4


def rank_block(found: Index, block: Block, kind: str, top: int = TOP) -> DataFrame:
    """item_id, id and score: the best documents of each task for each item of a block with weights."""
    doc_kind = found.rows.schema["id"].dataType.simpleString()
    n_docs, n_terms = found.n_docs, found.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in block.items]
        id_type = None
        for b in batches:
            if not b.num_rows:
                continue
            hashes, at = _flat(b.column("terms"))
            strata = Strata(block, b.column("n").to_numpy(), hashes, at, _flat(b.column("tfs"))[0], n_docs, n_terms)
            column = b.column("id")
            id_type, null = column.type, column.is_null().to_numpy(zero_copy_only=False)
            ids = column.fill_null("" if pa.types.is_string(column.type) else 0).to_numpy(zero_copy_only=False)
            for item, kept in enumerate(best):
                _visit(strata, block, item, kept, ids, null)
        if id_type is None:
            return
        item_type = pa.array(block.items).type if any(i is not None for i in block.items) else pa.int64()
        for item, kept in enumerate(best):
            if len(kept.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.items[item]] * len(kept.score), item_type), pa.array(kept.id, id_type, mask=kept.null), pa.array(kept.score)], ["item_id", "id", "score"])

    return found.rows.mapInArrow(run, f"item_id {kind}, id {doc_kind}, score long")


def search(found: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS, doc_col: str = "doc_id") -> DataFrame:
    """item, rank, document and score: the `top` best documents with a score above 0 of every item."""
    kind = items.schema[id_col].dataType.simpleString()
    spark, doc_kind = items.sparkSession, found.rows.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, id {doc_kind}, score long")
    for block in blocks(items, id_col, text_col, block_terms) if found.n_docs else ():
        df = document_counts(found, block)
        block.weight = np.where(df > 0, weights(df, found.n_docs), 0)
        out = out.unionByName(rank_block(found, block, kind, top))
    by = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    first = Window.partitionBy("item_id", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).orderBy(*by)
    out = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by))).where(F.col("rank") <= top)
    return out.select(F.col("item_id").alias(id_col), "rank", F.col("id").alias(doc_col), "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_lexical": op11_lexical}

_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = {"op11_lexical": f"""
WITH t AS MATERIALIZED (SELECT doc_id, {_TERMS_SQL} AS ts FROM documents),
d AS MATERIALIZED (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
g AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
p AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
i AS MATERIALIZED (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS part FROM p JOIN d USING (doc_id) JOIN w USING (term), g),
s AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""}
