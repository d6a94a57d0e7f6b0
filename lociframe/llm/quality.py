"""Quality rules: boosted trees over document statistics, scored from flat node arrays.

`statistics` measures whole texts slice by slice with array work in Arrow batches; nothing is
shuffled. `fit` grows the trees from a bounded sample of labelled rows (`sample_rows`, a
parameter). Splits on the features in `MONOTONE` keep the score non-increasing in them, so a text
can't gain by more symbols, shouting or repeats. `judge` and `keep` score every row: all trees step
down together through numpy arrays of feature, threshold and child numbers.

Defined results: null and empty texts have no words and fail the base rules; repeated rows and ids
are judged one by one; an input column named like a result column is replaced; an empty table
gives an empty result; without labels of both kinds the model accepts all that passes the base
rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import FOLLOWS, Words, binary_of, raw, slices, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: features of the trees; shares keep long and short texts comparable
FEATURES = (
    "log_words", "word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "mark_share", "bar_share", "distinct_share", "line_words", "closed_share",
)
#: features in which the score never rises
MONOTONE = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "bar_share", "mark_share")
SLICE = 1 << 20  # bytes of text measured at once: the arrays over its words take a multiple of it
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _repeats(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where the same code stands elsewhere in the same row (first included)."""
    order = np.argsort(code, kind="stable")  # stable: rows stay in order within a code
    same = (code[order[1:]] == code[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    out = np.zeros(len(code), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _later(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where the same code stands earlier in the same row."""
    order = np.argsort(code, kind="stable")
    same = (code[order[1:]] == code[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    out = np.zeros(len(code), bool)
    out[order[1:]] = same
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact code of two codes below 2**31 each, renumbered."""
    return np.unique(a * np.int64(1 << 31) + b, return_inverse=True)[1].astype(np.int64)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of each text of a slice."""
    data, at = raw(column)
    w = Words(data, at)
    words = w.counts.astype(np.int64)
    code, spellings = w.codes()
    lead = ~FOLLOWS[data]
    out = {"n_words": words, "word_chars": w.per_row(lead & ~w.space), "n_symbols": w.per_row(_SYMBOL[data])}

    # lines: the bytes between newlines and row ends
    newline = data == 10
    marks = np.flatnonzero(newline)
    row_of_mark = np.searchsorted(at, marks, "right") - 1
    starts = np.concatenate((at[:-1], marks + 1))
    row = np.concatenate((np.arange(w.rows), row_of_mark))
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.append(starts[1:] - 1, len(data))
    last = np.append(row[1:] != row[:-1], True)
    ends[last] = at[row[last] + 1]
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    kept = np.concatenate(([0], np.cumsum(~newline)))
    lines = binary_of(data[~newline], np.append(kept[starts], kept[-1])).dictionary_encode()
    dup = _later(lines.indices.to_numpy(zero_copy_only=False).astype(np.int64), row) & has_word
    out["n_dup_lines"] = np.bincount(row, dup, w.rows).astype(np.int64)

    # three-word windows inside a row
    covered = np.zeros(len(code), bool)
    if len(code) >= 3:
        inside = w.row[2:] == w.row[:-2]
        triple = _pair(_pair(code[:-2], code[1:-1]), code[2:]) if len(spellings) > 1_000_000 else (code[:-2] * len(spellings) + code[1:-1]) * len(spellings) + code[2:]
        at3 = np.flatnonzero(inside)
        twice = at3[_repeats(triple[at3], w.row[at3])]
        for shift in range(3):
            covered[twice + shift] = True
    out["n_repeat_words"] = np.bincount(w.row, covered, w.rows).astype(np.int64)

    n, chars = np.maximum(words, 1), np.maximum(out["word_chars"], 1)
    filled = np.maximum(np.bincount(row, has_word, w.rows), 1)
    body = np.searchsorted(w.starts, ends) - 1  # last word before each line's end
    tail = np.zeros(len(ends), bool)
    word_end = np.append(w.starts[1:], len(data)) if len(w.starts) else np.zeros(0, np.int64)
    if len(w.starts):
        gap = np.concatenate(([0], np.cumsum(w.space)))
        word_end = word_end - (gap[word_end] - gap[w.starts])
        tail[has_word] = np.isin(data[word_end[body[has_word]] - 1], np.frombuffer(b".!?:\"'", np.uint8))
    out |= {
        "log_words": np.log1p(words), "word_len": out["word_chars"] / n, "symbol_share": out["n_symbols"] / chars,
        "dup_line_share": out["n_dup_lines"] / filled, "repeat_share": out["n_repeat_words"] / n,
        "upper_share": w.per_row((data >= 65) & (data <= 90)) / chars, "digit_share": w.per_row((data >= 48) & (data <= 57)) / chars,
        "mark_share": w.per_row((data == 33) | (data == 63)) / n, "bar_share": w.per_row(data == 124) / n,
        "distinct_share": np.bincount(w.row, ~_later(code, w.row), w.rows) / n, "line_words": words / filled,
        "closed_share": np.bincount(row, tail, w.rows) / filled,
    }
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass
class Trees:
    """A boosted ensemble as flat arrays; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for the rows of x."""
        if not len(self.roots):
            return np.full(len(x), self.start)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        at = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, damp: float = 1.0) -> Trees:
    """Boost trees on logistic loss over binned features.

    signs: -1 where the score may not rise with a feature, else 0. A split on such a feature is
    taken only if its right side is not above its left side, and the middle of both bounds all
    values further down.
    """
    good = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    start = float(np.log(good / (1 - good))) if len(y) else 1.0
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
        margin = np.full(len(y), start)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            step = np.zeros(len(y))

            def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
                value = float(np.clip(rate * g[rows].sum() / (h[rows].sum() + damp), low, high))
                me = len(nodes)
                nodes.append([0, np.inf, me, me, value])
                best = None
                if level < depth and len(rows) >= 2:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for f, cut in enumerate(cuts):
                        if not len(cut):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cut) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cut) + 1))[:-1]
                        gr, hr = total_g - gl, total_h - hl
                        gain = gl**2 / (hl + damp) + gr**2 / (hr + damp) - total_g**2 / (total_h + damp)
                        ok = (hl > 1e-3) & (hr > 1e-3)
                        if signs[f]:
                            ok &= signs[f] * (gr / (hr + damp) - gl / (hl + damp)) >= 0
                        gain = np.where(ok, gain, -np.inf)
                        k = int(np.argmax(gain))
                        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                            best = (gain[k], f, k, gl[k], hl[k], gr[k], hr[k])
                if best is None:
                    step[rows] = value
                    return me
                _, f, k, gl, hl, gr, hr = best
                wl, wr = (float(np.clip(rate * a / (b + damp), low, high)) for a, b in ((gl, hl), (gr, hr)))
                goes = binned[rows, f] <= k
                bounds = [(low, high), (low, high)]
                if signs[f]:
                    mid = (wl + wr) / 2
                    bounds = [(mid, high), (low, mid)] if signs[f] < 0 else [(low, mid), (mid, high)]
                nodes[me][0], nodes[me][1] = f, cuts[f][k]
                nodes[me][2] = build(rows[goes], level + 1, *bounds[0])
                nodes[me][3] = build(rows[~goes], level + 1, *bounds[1])
                return me

            roots.append(build(np.arange(len(y)), 0, -np.inf, np.inf))
            margin += step
    flat = np.array(nodes or [[0, np.inf, 0, 0, 0.0]])
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), start, depth)


_STATS = ", ".join([*(f"{c} long" for c in BASE), *(f"{c} double" for c in FEATURES)])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, the base counts and the features."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            s = measure(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(s[c]) for c in (*BASE, *FEATURES))], ["id", *BASE, *FEATURES])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {_STATS}").withColumnRenamed("id", id_col)


def sample(labels: DataFrame, id_col: str = "doc_id", label: str = "quality", sample_rows: int = 20_000) -> DataFrame:
    """At most `sample_rows` labelled rows, chosen by a hash of their id; the worst label of an id counts."""
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("double").alias("label"))
    picked = one.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    return F.broadcast(picked)  # bounded by sample_rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample_rows: int = 20_000, **how) -> Trees:
    """Grow the trees from a bounded sample of labelled rows.

    sample_rows bounds what reaches the driver: one row of statistics per sampled label, 150 bytes
    each. Ids that repeat in `docs` give only their row with the most words.
    """
    picked = sample(labels, id_col, label, sample_rows)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(picked, F.col("doc") == F.col("id"), "left_semi")
    best = statistics(texts, "doc").groupBy("doc").agg(F.max(F.struct(*BASE, *FEATURES)).alias("s")).select("doc", "s.*")
    rows = best.join(picked, F.col("doc") == F.col("id")).select("doc", "label", *FEATURES).toPandas().sort_values("doc")
    signs = np.array([-1 if f in MONOTONE else 0 for f in FEATURES])
    return grow(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float), signs, **how)


def _verdict(trees: Trees, s: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-trees.score(np.stack([s[c] for c in FEATURES], axis=1)))) if len(s["n_words"]) else np.zeros(0)
    return p, p >= least


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row: id, base counts, base_failed, score (chance of good quality) and kept."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            s = measure(b.column("text"))
            failed, (p, good) = base_failed(s), _verdict(trees, s, least)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(s[c]) for c in BASE), *map(pa.array, (failed, p, ~failed & good))], ["id", *BASE, "base_failed", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = ", ".join(f"{c} long" for c in BASE)
    return rows.mapInArrow(run, f"id {kind}, {out}, base_failed boolean, score double, kept boolean").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, trees: Trees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that pass, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE):
            s = measure(b.column(text_col))
            yield b.filter(pa.array(~base_failed(s) & _verdict(trees, s, least)[1]))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_quality_rules": op2_quality_rules}
