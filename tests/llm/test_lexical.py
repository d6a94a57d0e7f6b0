import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lociframe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def plain(docs, items, top):
    counted = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, n_docs = sum(sum(c.values()) for _, c in counted), len(counted)
    df = Counter(t for _, c in counted for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(TERM.findall((t or "").translate(UPPER)))
    out = []
    for item, terms in of.items():
        scored = []
        for i, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def got(spark, docs, items, top, **how):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int")
    found = lexical.search(lexical.index(d), q, top=top, **how)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)] + ["É", "É", "éé", "THE", "the", "ſ", "x-y", "한", "a_b"]
    docs = [(rng.choice([None, *range(1000)]), rng.choice([" ", "\n", "--", "!"]).join(rng.choices(words, k=int(rng.paretovariate(0.8)) % 300))) for _ in range(n)]
    items = [(rng.choice([None, *range(20)]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(25)]
    return docs, items


def test_by_the_letter(spark):
    for seed in range(2):
        docs, items = corpus(seed, 300)
        docs += docs[:9] + [(5, None), (6, ""), (7, "\x00-[]"), (8, "w1 " * 60_000), (9, "z" * 200_000)] + [(k, "the same text w1 w2") for k in range(400, 480)]
        items += items[:2] + [(50, None), (51, ""), (52, "unknown words"), (53, "w1 the " + "w2 " * 9999)]
        for top, block in ((3, 10), (50, 1 << 18)):
            assert got(spark, docs, items, top, block_terms=block) == plain(docs, items, top)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")], 5) == []
    assert got(spark, [(1, "a")], [], 5) == []
    assert got(spark, [(1, None), (2, "..")], [(1, "a")], 5) == []
    assert got(spark, [(1, "a")], [(1, "a")], 5) == plain([(1, "a")], [(1, "a")], 5)


def test_strata_are_bounded_and_skipped():
    """Bounds hold for every document, and the waves leave out what can't rank."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.6, size=size) if k < 500) for size in rng.integers(1, 400, 3000)]
    n, rows, hashes, tf = lexical.count_terms(pa.array(texts))
    order = np.argsort(n, kind="stable")
    at = np.searchsorted(rows, np.arange(len(n) + 1))
    keep = [k for k in order if n[k]]
    flat = np.concatenate([np.arange(at[k], at[k + 1]) for k in keep])
    ends = np.append(0, np.cumsum([at[k + 1] - at[k] for k in keep]))
    vocabulary = np.unique(hashes)
    rare = np.flatnonzero(np.bincount(np.searchsorted(vocabulary, hashes)) < 40)[:4]
    block = lexical.Block([1], vocabulary, rare, np.array([0, len(rare)]))
    block.weight = lexical.weights(np.bincount(np.searchsorted(vocabulary, hashes)), len(keep))
    strata = lexical.Strata(block, n[keep], hashes[flat], ends, tf[flat], len(keep), int(n.sum()))
    bounds = strata.bounds(rare, block.weight[rare])
    every = strata.scores(rare, block.weight[rare], np.ones(len(bounds), bool))
    assert (every <= bounds[strata.of_doc]).all() and every.max() > 0
    visits = []
    plain_scores = strata.scores
    strata.scores = lambda terms, weight, visited: visits.append(int(visited.sum())) or plain_scores(terms, weight, visited)
    best = lexical.Best(5)
    lexical._visit(strata, block, 0, best, np.arange(len(keep)), np.zeros(len(keep), bool))
    assert sorted(best.score.tolist()) == sorted(every.tolist())[-5:]
    assert sum(visits) < len(bounds) / 2
