import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lociframe.llm import fingerprint as fp
from lociframe.llm.common import raw, table


def plain_steps(data):
    out = []
    for i in range(len(data) - 63):
        s = sum(fp._C_LOG_C[c] for c in Counter(data[i : i + 64]).values())
        out.append(int((fp._FULL - s) * 1000 // fp._FULL))
    return out


def plain_features(data, ranks):
    """Feature starts by the letter."""
    order = [(ranks[s], i) if ranks[s] else (math.inf, i) for i, s in enumerate(plain_steps(data))]
    points = Counter(min(order[i : i + 64])[1] for i in range(len(order) - 63) if min(order[i : i + 64])[0] < math.inf)
    return sorted(i for i, p in points.items() if p >= 16)


def samples():
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(200)]
    return ["", "a", "ab" * 40, "x" * 300, *(" ".join(rng.choices(words, k=k)) for k in (5, 12, 20, 60, 300)), "é" * 70, rng.randbytes(400).hex()]


def test_steps_and_features_by_the_letter():
    texts = samples()
    seen = Counter(s for t in texts for s in plain_steps(t.encode()))
    ranks = np.zeros(1001, np.int64)
    for r, (_, s) in enumerate(sorted((n, -s) for s, n in seen.items() if s >= fp.LEAST_STEP)):
        ranks[-s] = r + 1
    data, at = raw(pa.array(texts))
    chosen, before = fp.features(data, at, ranks)
    for i, t in enumerate(texts):
        assert fp.steps(np.frombuffer(t.encode(), np.uint8)).tolist() == plain_steps(t.encode())
        assert (chosen[before[i] : before[i + 1]] - at[i]).tolist() == plain_features(t.encode(), ranks), t[:20]
    together = fp.digests(data, at, ranks)
    assert together == [fp.digests(*raw(pa.array([t])), ranks)[0] for t in texts]


def test_likeness():
    rng = random.Random(4)
    ranks = np.arange(1001)
    one, two = (rng.randbytes(30_000).hex() for _ in range(2))
    a, half, b = (fp.digests(*raw(pa.array([t])), ranks)[0] for t in (one, one[:30_000] + two[:30_000], two))
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) < 0.1 and 0.35 < fp.likeness(a, half) < 0.7
    assert fp.likeness("0:", a) == 0 and fp.likeness("0:", "0:") == 1


def check(spark, docs):
    ranks = fp.rarity(docs)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    prints = fp.digests(*raw(pa.array([t for _, t in rows], pa.string())), ranks)
    for k, (i, t) in enumerate(rows):
        n = (k + 1) % len(rows)
        changed = t[: len(t) - len(t) // 2] + rows[n][1][: len(t) // 2]
        new = fp.digests(*raw(pa.array([changed])), ranks)[0]
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), prints[k], new, fp.likeness(prints[k], new), fp.likeness(prints[k], prints[n])))
    got = [tuple(r) for r in fp.compare_with_next(docs, ranks).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_documents_against_next(spark):
    got = check(spark, table(spark, "/root/testdata/sf0.001", "documents"))
    assert np.mean([r[5] for r in got]) > 0.4 and np.mean([r[6] for r in got]) < 0.2


def test_odd_rows(spark):
    data = [(3, None, 1), (3, "b" * 90, 1), (3, "a", 1), (None, "null id", 2), (1, "", 3), (7, "long " * 40000, 3), (2, "é漢" * 100, 3), (2, "é漢" * 100, 3)]
    check(spark, spark.createDataFrame(data, "doc_id long, text string, fingerprint long").repartition(4))
    check(spark, spark.createDataFrame(data[1:2], "doc_id long, text string, fingerprint long"))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fp.compare_with_next(none, fp.rarity(none)).count() == 0
