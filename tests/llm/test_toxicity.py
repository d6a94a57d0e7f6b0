import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lociframe.llm import toxicity
from lociframe.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    ones = label.sum()
    assert len(order) == len(label) and 0 < ones < len(label)
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels").where(~toxicity.held_out()))


def plain_windows(text):
    """Windows by the letter."""
    b = bytes(b | 32 if 65 <= b <= 90 else 32 if b in (32, 9, 10, 11, 12, 13) else b for b in (text or "").encode())
    if not b.strip():
        return []
    begins = [i for i in range(len(b)) if b[i] != 32 and (i == 0 or b[i - 1] == 32)]
    cuts = [0]
    for k in range(toxicity.WINDOW, len(b), toxicity.WINDOW):
        cuts.append(next((i for i in begins if k <= i < k + toxicity.WINDOW), k))
    out = []
    for a, z in zip(cuts, [*cuts[1:], len(b)]):
        out.append(b[a - 1 if a and b[a - 1] == 32 else a : z])
    return out


ODD = [None, "", " \n\t", "A", "word " * 500, "z" * 5000, "É" * 300 + " x", "a" * 95 + " b", "a" * 96 + " b", "a " * 96, " lead", "trail ", "x" * 200 + " " * 200 + "y"]


def test_windows_by_the_letter():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("aB \n.é", k=rng.randrange(700))) for _ in range(40)]
    data, row, starts, sizes = toxicity.windows(pa.array(texts, pa.string()))
    whole = data.tobytes()
    got = [[] for _ in texts]
    for r, a, n in zip(row, starts, sizes):
        got[r].append(whole[a : a + n])
    assert got == [plain_windows(t) for t in texts]


def test_lengths_and_stats_by_the_letter(model):
    texts = ["You are an idiot and a moron, truly pathetic. " * 5, "the nt hain erblest", *[t for t in ODD if t]]
    import zstandard as zstd

    how = zstd.ZstdCompressionParameters(
        format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, window_log=18, hash_log=17, chain_log=17, search_log=5,
        min_match=5, target_length=16, strategy=zstd.STRATEGY_GREEDY)
    tools = [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how) for c in (model.pair.ordinary, model.pair.ordinary + model.pair.toxic)]
    got = model.pair.measure(pa.array(texts))
    for t, x in zip(texts, got):
        gains = [len(tools[0].compress(w)) - len(tools[1].compress(w)) for w in plain_windows(t)] or [0]
        want = [max(gains), np.mean(gains), *(np.mean([g >= k for g in gains]) for k in (2, 3, 5)), *(sum(g >= k for g in gains) for k in (2, 3, 5))]
        assert np.allclose(x[:-1], want), (t[:40], x, want)


def test_held_out_accuracy(spark, model):
    """A model of a tenth of a small table ranks the rows that it has not seen."""
    found = {r.doc_id: r for r in toxicity.op12_toxicity(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in found.items())
    labels = [r for r in table(spark, SF, "labels").collect() if found[r.doc_id].held_out]
    y = np.array([r.toxic for r in labels])
    s = np.array([found[r.doc_id].score for r in labels])
    assert auc(s, y) > 0.75


def test_held_out_accuracy_of_more_rows(spark):
    """Ten times the labels: few ordinary rows are taken for toxic. On the small table it is 5 of 95."""
    large = "/root/testdata/sf0.1"
    found = toxicity.op12_toxicity(spark, large).where("held_out").join(table(spark, large, "labels"), "doc_id").collect()
    y, s = np.array([r.toxic for r in found]), np.array([r.score for r in found])
    assert auc(s, y) > 0.93
    assert np.mean(s[y == 0] >= 0.7) < 0.03 and np.mean(s[y == 1] >= 0.7) > 0.6


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(k % 4 if k % 3 else None, t, "clash", 1.0) for k, t in enumerate(ODD * 2)], "doc_id long, text string, half string, score double").repartition(3)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"]
    by = {}
    rows = got.collect()
    assert len(rows) == 2 * len(ODD) and all(0 <= r.score <= 1 for r in rows)
    for t, x in zip(ODD, model.score(pa.array(ODD, pa.string()))):
        by.setdefault(t or "", set()).add(float(x))
    assert len(by[""]) == 1
    assert sorted(r.score for r in rows) == pytest.approx(sorted(2 * [float(x) for x in model.score(pa.array(ODD, pa.string()))]))
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score < 1e-9 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [True, True]
    one = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.fit(docs, one)).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), one)).count() == 0
