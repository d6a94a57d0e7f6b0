"""Line dedup with overlapping three-line windows, in DataFrame functions only.

Lines are the pieces between newlines; lines without a word stand outside (they are neither counted
in windows nor removed). Every three consecutive remaining lines of a document form a window, known
by 128 bits of hash. A window's first occurrence is that with the smallest (id, text digest, place);
every later occurrence, in another document or further down, is covered, and the union of the
covered places goes.

What moves between tasks is one short row per window and, once, the texts. Counting a window that a
third of all documents hold is a partial aggregation; the join that finds its later occurrences has
one row on the other side, so adaptive execution splits it.

Defined results: null texts stay null and empty ones empty; fewer than three lines with words never
lose any; rows with equal id and equal text are one document (both stay alike), rows with equal id
and different texts are ordered by text digest; a null id comes before all others; an input column
named like a result column is replaced; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import fresh, table

SIZE = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k (id and text digest), w (place among the lines with words), h1, h2 and the three line places."""
    lines = F.transform(F.split(text_col, "\n"), lambda line, i: F.struct(i.alias("p"), line.rlike(HAS_WORD).alias("full"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit("b"), line).alias("b")))
    # the array passes through explode so that the lambdas below read it instead of computing it again
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.md5(text_col).alias("t")).alias("k"), F.explode(F.array(F.filter(lines, lambda x: x["full"]))).alias("l"))
    rows = rows.where(F.size("l") >= SIZE)
    at = lambda i, j, name: F.get("l", i + j)[name]
    window = F.transform(
        F.sequence(F.lit(0), F.size("l") - SIZE),
        lambda i: F.struct(
            i.alias("w"), F.xxhash64(*[at(i, j, "a") for j in range(SIZE)]).alias("h1"), F.xxhash64(*[at(i, j, "b") for j in range(SIZE)]).alias("h2"),
            F.array(*[at(i, j, "p") for j in range(SIZE)]).alias("places")))
    return rows.select("k", F.inline(window))


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k and the places of its lines that go, for documents that lose any."""
    windows = _windows(docs, id_col, text_col)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("k", "w")).alias("first"), F.max(F.struct("k", "w")).alias("last")).where("first <> last").drop("last")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("k", "w") != F.col("first"))
    return later.select("k", F.explode("places").alias("p")).groupBy("k").agg(F.collect_set("p").alias("places"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: str | None = None) -> DataFrame:
    """Every row with the repeated lines cut from its text; `count` names a column for their number."""
    kept = [c for c in docs.columns if c.lower() != (count or "").lower()]
    key, lines, goes = fresh(docs, "row_key", "row_lines", "row_places")
    gone = covered(docs, id_col, text_col).select(F.col("k").alias(goes + "_k"), F.col("places").alias(goes))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept if c != text_col], F.struct(F.col(id_col).alias("id"), F.md5(text_col).alias("t")).alias(key), F.split(text_col, "\n").alias(lines))
    rows = rows.join(gone, F.col(key).eqNullSafe(F.col(goes + "_k")), "left")
    # array_except is linear; the join below it keeps the split from being computed per element
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), goes)
    cut = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(goes).isNull(), F.array_join(lines, "\n")).otherwise(cut)
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    if count:
        out.append(F.coalesce(F.size(goes), F.lit(0)).cast("long").alias(count))
    return rows.select(*out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_removed")


ORACLE_SQL = {"op9_line_dedup": r"""
WITH l AS (SELECT doc_id, line, pos FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)),
f AS (SELECT doc_id, line, pos, row_number() OVER d AS w,
             lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3, lead(pos, 1) OVER d AS p2, lead(pos, 2) OVER d AS p3
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, w) AS nth FROM f WHERE p3 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([pos, p2, p3]) AS pos FROM o WHERE nth > 1),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n_removed
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed FROM documents LEFT JOIN k USING (doc_id)"""}

QUERIES = {"op9_line_dedup": op9_line_dedup}
