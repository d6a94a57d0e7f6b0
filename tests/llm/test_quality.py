import re
from collections import Counter

import numpy as np
import pytest

from lociframe.llm import quality
from lociframe.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base counts by the letter."""
    text = text or ""
    words = WORD.findall(text)
    wins = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


ODD = [
    None, "", " ", "\n\n", "a", "a b c a b c", "x\ny\nx\n x\nx", "ünï çöde nbsp  wide\x1cfs", "one two three " * 30000, "|# " * 70, "é" * 5,
    "a a a a a a", "\t\x0b\x0c\r tail", "z" * 200_000, "q\n" * 60,
]


def check(spark, docs, trees):
    got = {(r.doc_id, i): r for i, r in enumerate(quality.judge(docs, trees).collect())}
    texts = [r.text for r in docs.collect()]
    for (_, i), r in got.items():
        n, chars, sym, dup, rep, failed = plain(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, sym, dup, rep, failed), texts[i] and texts[i][:50]
        assert not (failed and r.kept)


def test_counts_by_the_letter(spark):
    docs = table(spark, SF, "documents")
    trees = quality.fit(docs, table(spark, SF, "labels"))
    check(spark, docs.coalesce(1), trees)
    odd = spark.createDataFrame([(i % 5 if i % 3 else None, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, n_words string").coalesce(1)
    check(spark, odd, trees)
    kept = quality.keep(odd, trees)
    assert kept.columns == odd.columns
    assert quality.judge(odd.limit(0), trees).count() == 0


def test_held_out_accuracy_and_clean_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    trees = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs, trees).where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in held if r.quality == 1]
    bad = [r.kept for r in held if r.quality == 0]
    assert np.mean(good) > 0.98
    assert np.mean(bad) < 0.1


def test_score_never_rises_in_monotone_features(spark):
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (rng.random(3000) < 0.5 + 0.4 * np.sin(7 * x[:, 2]) * x[:, 0]).astype(float)
    signs = np.array([-1 if f in quality.MONOTONE else 0 for f in quality.FEATURES])
    trees = quality.grow(x, y, signs)
    base = rng.random((200, len(signs)))
    for f in np.flatnonzero(signs):
        line = np.repeat(base, 40, axis=0)
        line[:, f] = np.tile(np.linspace(0, 1, 40), 200)
        assert (np.diff(trees.score(line).reshape(200, 40), axis=1) <= 1e-9).all()


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_one_kind_of_label(y):
    x = np.zeros((len(y), len(quality.FEATURES)))
    trees = quality.grow(x, np.array(y), np.zeros(len(quality.FEATURES)))
    assert len(trees.score(np.ones((3, len(quality.FEATURES))))) == 3
