"""Near duplicates: fast similarity sketches, banding, exact verification, components.

A document's set holds the distinct five-word shingles of its whole text. The sketch has 128
coordinates, filled in rounds: in round i every element falls into one bin by a hash of its own and
the least value of a bin stays; only bins that were empty before the round are filled by it. Most
texts are done after a round or two. Rounds 128 to 255 send every element to one given bin each, so
no coordinate of a non-empty set stays empty. Coordinates of two sets agree with the chance of
their similarity, with the concentration of independent bins.

1. `sketch`: one pass over the texts; number of shingles, 128-bit digest of the set, 32 band keys.
2. Equal digests are equal sets: one representative each. A group of copies, however large, is
   collapsed by a partial aggregation before anything else moves.
3. Every bucket of a band proposes links between its smallest representative and the others (no
   pairs inside the bucket), confirmed on the full sets. Components of the confirmed links follow by
   alternating star contractions.
4. Buckets that still hold several components (one bucket of each set of members) compare what lies
   outside their largest component with all their members, in blocks of about 512 by 512: the
   intersections of a block come from one product of its membership matrices, and a task gives
   back one link for a document and a component it reaches, never the pairs. After that every
   pair that shares a bucket is linked, in one component, or refuted: nothing is capped.

With 4 coordinates in each of 32 bands a pair at similarity 0.75 shares no bucket with chance
0.000005, at 0.8 with 0.00000005.

Defined results: null and empty texts and texts of white space have empty sets and are linked with
nothing; fewer than five words form one shingle; rows with one id are one document, linked if any of
its texts is; rows with a null id are never linked and are kept; other columns don't matter; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lociframe.llm.common import Words, fresh, mix64, raw, settle, slices, table

WIDTH, COORDS, BANDS = 5, 128, 32
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ROUND_SEEDS = np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * GOLDEN
LEAST = 75  # per cent
BLOCK, STRIPE = 512, 4096  # documents in a block, elements in a stripe of its matrices


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all rows, and where each row's begin (n + 1)."""
    words = Words(*raw(column))
    code, spellings = words.codes(lower=True)
    h = np.fromiter(map(xxh3_64_intdigest, spellings.to_pylist()), np.uint64, len(spellings))[code]
    n = words.counts
    sizes = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    flat = np.empty(int(sizes.sum()), np.uint64)
    if len(h) >= WIDTH:
        acc = h[: 1 - WIDTH]
        for j in range(1, WIDTH):
            acc = mix64(acc * GOLDEN + h[j : len(h) - WIDTH + 1 + j])
        flat[np.repeat(n >= WIDTH, sizes)] = acc[words.row[WIDTH - 1 :] == words.row[: 1 - WIDTH]]
    at = np.append(0, np.cumsum(sizes))
    for size in range(1, WIDTH):  # whole sequences
        rows = np.flatnonzero(n == size)
        acc = np.full(len(rows), size, np.uint64)
        for j in range(size):
            acc = mix64(acc * GOLDEN + h[words.before[rows] + j])
        flat[at[rows]] = acc
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        flat[a:b].sort()
    distinct = np.ones(len(flat), bool)
    distinct[1:] = flat[1:] != flat[:-1]
    distinct[at[:-1][sizes > 0]] = True
    return flat[distinct], np.append(0, np.cumsum(distinct))[at]


def fill(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sketches of the sets, a row of COORDS values each; rows of empty sets stay at the maximum."""
    n, sizes = len(at) - 1, np.diff(at)
    out = np.full(n * COORDS, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(n * COORDS, bool)
    x, row = hashes, np.repeat(np.arange(n), sizes)
    for i in range(2 * COORDS):
        if not len(x):
            break
        v = mix64(x + ROUND_SEEDS[i])
        slot = row * COORDS + (v >> np.uint64(57)).astype(np.int64) if i < COORDS else row * COORDS + i - COORDS
        free = ~filled[slot]
        np.minimum.at(out, slot[free], v[free])
        filled[slot[free]] = True
        going = ~filled.reshape(n, COORDS).all(axis=1)[row]
        x, row = x[going], row[going]
    return out.reshape(n, COORDS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One key for each band of each sketch; the band is part of the key."""
    parts = sketches.reshape(len(sketches), BANDS, COORDS // BANDS)
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for j in range(parts.shape[2]):
        acc = mix64(acc * GOLDEN + parts[:, :, j])
    return acc.view(np.int64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, digest of the set (hi, lo) and band keys of every row; empty sets have no keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, at = shingle_sets(b.column("text"))
            n = np.diff(at)
            digest = np.frombuffer(b"".join(blake2b(sets[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at[:-1], at[1:])), np.int64).reshape(-1, 2)
            keys = band_keys(fill(sets, at))[n > 0]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((n > 0) * BANDS)), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["id", "n", "hi", "lo", "keys"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, hi long, lo long, keys array<long>")


def confirm(edges: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """Edges (a, b) whose full sets have 100 * intersection >= least * union. texts: id, text."""
    both = edges.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(slices(batches, "x"), "y"):
            sets: list[list[np.ndarray]] = []
            for name in ("x", "y"):
                found = part.column(name).dictionary_encode()  # the texts of a hub are hashed once
                flat, at = shingle_sets(found.dictionary)
                own = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
                sets.append([own[k] for k in found.indices.to_pylist()])
            linked = []
            for p, q in zip(*sets):
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(small) < least * len(large) or not len(small):
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                linked.append(100 * shared >= least * (len(p) + len(q) - shared))
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); component is the smallest node.

    Alternating large-star and small-star contractions; every round is a pair of grouped minima
    joined back to the edges, so no node's neighbours meet in one row, and the edges never outgrow
    the input. Rounds grow with the logarithm of the longest chain.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while mark[0]:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def meet(queries: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all queries with all members, by products over shared elements."""
    sets = [*queries, *members]
    sizes = np.array([len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    column, owner = number[at[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(queries), len(members)), np.float32)
    for low in range(0, int(shared.sum()), STRIPE):
        a, b = np.searchsorted(column, [low, low + STRIPE])
        grid = np.zeros((len(sets), STRIPE), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        out += grid[: len(queries)] @ grid[len(queries) :].T
    return out.astype(np.int64)


def across(named: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """Links (a, b) between components that meet in a bucket. named: rep, key, component of every bucket row."""
    mixed = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    # a repeated row, or a text of the same id in the same bucket, must not cancel the marks; dealt by both columns, so a hot bucket spreads
    rows = settle(named.join(mixed, "key").select("key", "rep", "component").repartition("key", "rep").distinct())
    marks = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit("y"))).alias("y")]
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"), *marks)
    keys = parts.groupBy("key").agg(F.sum("n").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("n", "component")).alias("main"))
    keys = keys.groupBy("size", "x", "y", "main").agg(F.min("key").alias("key"))  # buckets of the same members once
    blocks = keys.select("key", F.col("main.component").alias("main"), F.ceil(F.col("size") / BLOCK).alias("nm"), F.ceil((F.col("size") - F.col("main.n")) / BLOCK).alias("nq"))
    placed = rows.join(blocks, "key").withColumn("q", F.col("component") != F.col("main")).withColumn("own", F.pmod(F.xxhash64("rep"), "nm")).withColumn("own_q", F.pmod(F.xxhash64("rep", F.lit("q")), "nq"))
    columns = ["key", "mb", "qb", "rep", "component", "member", "q"]
    as_member = placed.withColumn("qb", F.explode(F.expr("sequence(0L, nq - 1)"))).withColumn("mb", F.col("own")).withColumn("member", F.lit(True)).withColumn("q", F.col("q") & (F.col("qb") == F.col("own_q")))
    as_query = placed.where("q and nm > 1").withColumn("mb", F.explode(F.expr("sequence(0L, nm - 1)"))).where("mb <> own").withColumn("qb", F.col("own_q")).withColumn("member", F.lit(False))
    spread = as_member.select(columns).unionByName(as_query.select(columns))
    grouped = spread.join(texts.select(F.col("id").alias("rep"), "text"), "rep").groupBy("key", "mb", "qb")
    kind = named.schema["rep"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        found = group.column("text").combine_chunks().dictionary_encode()
        flat, at = shingle_sets(found.dictionary)
        sets = [flat[at[k] : at[k + 1]] for k in found.indices.to_pylist()]
        rep, component = group.column("rep").to_pylist(), group.column("component").to_pylist()
        qs = np.flatnonzero(group.column("q").to_numpy())
        ms = np.flatnonzero(group.column("member").to_numpy())
        links: dict[tuple, tuple] = {}
        if len(qs) and len(ms):
            sizes = np.array([len(x) for x in sets])
            shared = meet([sets[i] for i in qs], [sets[i] for i in ms])
            hits = 100 * shared >= least * (sizes[qs][:, None] + sizes[ms][None, :] - shared)
            for i, j in zip(*np.nonzero(hits & (shared > 0))):
                a, b = qs[i], ms[j]
                if component[a] != component[b]:
                    links.setdefault((rep[a], component[b]), (rep[a], rep[b]))
        kinds = group.schema.field("rep").type
        return pa.table({"a": pa.array([x for x, _ in links.values()], kinds), "b": pa.array([y for _, y in links.values()], kinds)})

    return grouped.applyInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_shingles, component_id and kept of every row."""
    all_rows = settle(sketch(docs, id_col, text_col))
    rows = all_rows.where("n > 0 and id is not null")
    reps = rows.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    members = settle(rows.join(reps, ["hi", "lo"]).select("id", "rep", "n", F.when(F.col("id") == F.col("rep"), F.col("keys")).alias("keys")))
    bucketed = members.where("keys is not null").select("rep", "n", F.explode("keys").alias("key"))

    hubs = bucketed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").drop("last")
    edges = settle(bucketed.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    texts = settle(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(nodes, "id"))
    links = confirm(edges, texts, least)
    # an id that has several sets joins them
    several = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("id", "a")
    links = settle(links.unionByName(members.join(several, "id").where("rep <> a").select(F.col("rep").alias("b"), "a").select("a", "b")))
    found = components(links)

    more = settle(across(bucketed.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), texts, least))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    classes = members.select("id", "rep").distinct().join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = all_rows.select("id", "n").join(classes, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id."""
    (other,) = fresh(docs, "gone")
    gone = near_duplicates(docs, id_col, text_col, least).where("not kept").select(F.col(id_col).alias(other)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(other), "left_anti")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


WORDS_SQL = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: exact, by an inverted index of all shingles and reachability
ORACLE_SQL = {"op10_minhash": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
d AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT d.b, r.reached FROM r JOIN d ON d.a = r.node WHERE r.reached < d.b)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node) LEFT JOIN n USING (doc_id)"""}

QUERIES = {"op10_minhash": op10_minhash}
