import random
import re

import numpy as np
import pyarrow as pa

from lociframe.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain(rows):
    """id -> (sizes, component) by the letter; ids are nodes, null ids stand alone."""
    nodes = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(5)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    root = plain(rows)
    want = sorted(((i, len(shingles(t)), root.get(i), i is None or root[i] == i) for i, t in rows), key=str)
    assert got == want
    kept = {r.doc_id for r in minhash.keep(docs).collect()}
    assert kept == {i for i in root if root[i] == i} | ({None} if any(i is None for i, _ in rows) else set())
    return root


def edit(rng, words, share, vocab):
    return [rng.choice(vocab) if rng.random() < share else w for w in words]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 999}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tB"), (6, "a b c"), (7, "a b c d e"), (8, "a b c d E"), (9, long), (10, long + " x"), (None, "a b c d e"),
            (None, "q"), (11, "é É"), (12, "é é"), (20, "one two three four five six"), (20, "seven eight nine ten eleven"), (21, "seven eight nine ten eleven"), (22, "one two three four five six"), (22, "one two three four five six")]
    root = check(spark, rows)
    assert root[5] == 4 and root[8] == 7 and root[10] == 9 and root[22] == root[21] == 20 and root[12] == 12
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_of_near_copies(spark):
    """Groups whose members are more and less edited, so that hubs of buckets miss links that others have."""
    rng = random.Random(11)
    vocab = [f"t{i}" for i in range(400)]
    rows, n = [], 0
    for size, length in ((60, 150), (40, 40), (25, 300), (12, 9), (30, 1000)):
        base = rng.choices(vocab, k=length)
        for _ in range(size):
            rows.append((n, " ".join(edit(rng, base, rng.choice((0, 0.005, 0.01, 0.02, 0.03, 0.05)), vocab))))
            n += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "STRIPE", 16)
    rng = random.Random(3)
    vocab = [f"t{i}" for i in range(300)]
    base = rng.choices(vocab, k=80)
    check(spark, [(i, " ".join(edit(rng, base, rng.choice((0, 0.01, 0.03, 0.05, 0.08)), vocab))) for i in range(90)])


def test_repeated_rows_do_not_hide_buckets(spark):
    """Both buckets hold documents 1 to 3 and one more; with every row twice they still have different members."""
    words = [f"w{i}" for i in range(60)]
    texts = {1: words, 2: words[:-1], 3: words + ["x1", "x2"], 4: ["other"] * 3 + [f"o{i}" for i in range(60)], 5: words[8:] + ["x1", "x2"]}
    rows = [(rep, key, 1 if rep < 4 else rep) for key, reps in ((10, (1, 2, 3, 4)), (20, (1, 2, 3, 5))) for rep in reps]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    for times in (1, 2, 3):
        named = spark.createDataFrame(rows * times, "rep long, key long, component long")
        assert {r.a for r in minhash.across(named, docs).collect()} == {5}, times


def test_sketch_estimates_and_never_leaves_gaps():
    rng = np.random.default_rng(1)
    errors = []
    for size in (1, 2, 30, 127, 500):
        for share in (0.5, 0.75, 0.9):
            both = max(1, round(2 * size * share / (1 + share)))
            sets = [np.sort(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(2)]
            sets[1] = np.sort(np.concatenate([sets[0][:both], sets[1][both:]]))
            s = minhash.fill(np.concatenate(sets), np.array([0, size, 2 * size]))
            assert (s != np.iinfo(np.uint64).max).all()
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            errors.append(abs((s[0] == s[1]).mean() - true))
    assert np.mean(errors) < 0.05 and max(errors) < 0.2
    assert (minhash.fill(np.zeros(0, np.uint64), np.array([0, 0])) == np.iinfo(np.uint64).max).all()


def test_meet():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, k).astype(np.uint64)) for k in (5, 30, 1, 60, 20)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]
    assert minhash.meet(sets[:2], sets[2:]).tolist() == want


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200) if i != 100] + [(500, 400), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 101 for i in range(101, 201)} | {400: 400, 500: 400}


def test_shingles_like_the_letter():
    texts = ["a b c d e a b c d e f", "x", "", "A b", "é É é É é É", "a\x0bb\x0cc\x1cd e f g"]
    flat, at = minhash.shingle_sets(pa.array(texts))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
