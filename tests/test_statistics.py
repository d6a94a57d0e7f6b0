"""Fixed values and brute force for what SQL cannot say."""

import math
import time
from collections import Counter
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import aggregates as A
from lociframe.operators import aligned as L
from lociframe.operators import genotype as G
from lociframe.operators import sets as U
from lociframe.operators import walks as W


def plain_fisher(a, b, c, d):
    """Exact, by ratios of neighbours in fractions of the observed table's weight."""
    r1, r2, c1 = a + b, c + d, a + c
    low, high = max(0, c1 - r2), min(r1, c1)
    with localcontext() as how:
        how.prec = 40
        w, total, tail = Decimal(1), Decimal(0), Decimal(0)
        least = w + Decimal("1e-25")
        for k in range(a, high + 1):  # from the observed table to the upper end
            total, tail = total + w, tail + (w if w <= least else 0)
            w = w * (r1 - k) * (c1 - k) / ((k + 1) * (r2 - c1 + k + 1))
            if w < Decimal("1e-35") * total:
                break
        w = Decimal(1)
        for k in range(a, low, -1):
            w = w * k * (r2 - c1 + k) / ((r1 - k + 1) * (c1 - k + 1))
            total, tail = total + w, tail + (w if w <= least else 0)
            if w < Decimal("1e-35") * total:
                break
        return float(tail / total)


def test_fisher(spark):
    rows = [(3, 1, 1, 3), (10, 2, 3, 15), (8, 2, 1, 5), (60, 30, 20, 10), (0, 0, 0, 0), (0, 5, 0, 7), (5, 0, 7, 0), (0, 9, 9, 0), (1, 0, 0, 0), (200, 1, 3, 4000),
            (30, 70, 45, 55), (1000, 1100, 900, 1000), (2, 100_000, 15, 99_000), (50_500, 49_500, 49_500, 50_500), (500_500, 499_500, 499_500, 500_500)]
    d = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint")
    got = {tuple(r)[:4]: r.p for r in d.select("*", A.fisher_two_tailed(*map(F.col, "abcd")).alias("p")).collect()}
    for row in rows:
        assert got[row] == pytest.approx(plain_fisher(*row), rel=1e-8), row
    assert got[3, 1, 1, 3] == pytest.approx(0.4857142857, abs=1e-9)
    assert got[8, 2, 1, 5] == pytest.approx(0.0349650350, abs=1e-9)
    assert got[500_500, 499_500, 499_500, 500_500] == pytest.approx(0.157715, abs=1e-6)


def test_chi_square(spark):
    stats = [0.0, 1e-6, 0.5, 2.0, 3.841458820694124, 30.0, 700.0]
    got = [r.q for r in spark.createDataFrame([(s,) for s in stats], "s double").select(A.chi_square_log10_p(F.col("s")).alias("q")).collect()]
    assert got == pytest.approx([math.log10(math.erfc(math.sqrt(s / 2))) for s in stats], abs=1e-9)
    far = spark.createDataFrame([(2000.0,), (None,)], "s double").select(A.chi_square_log10_p(F.col("s")).alias("q")).collect()
    # the tail's asymptotic series; the number itself is below what a double holds
    z = 2000.0
    assert far[0].q == pytest.approx((-z / 2 + math.log(math.sqrt(2 / (math.pi * z)) * (1 - 1 / z + 3 / z**2))) / math.log(10), abs=1e-6)
    assert far[1].q is None
    stat = spark.createDataFrame([(3, 1, 1, 3)], "a bigint, b bigint, c bigint, d bigint").select(A.chi_square_stat(*map(F.col, "abcd")).alias("x")).first().x
    assert stat == pytest.approx(2.0)


def plain_rank(mid, adj):
    both = sorted([*mid, *adj])
    rank = {x: (2 * both.index(x) + both.count(x) + 1) / 2 for x in both}
    n1, n2, n = len(mid), len(adj), len(both)
    u = sum(rank[x] for x in mid) - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - sum(both.count(x) ** 3 - both.count(x) for x in set(both)) / (n * (n - 1)))
    return 0.5 * math.erfc((u - n1 * n2 / 2 - 0.5) / math.sqrt(2 * var)) if var > 1e-12 else 1.0


def plain_ks(mid, adj):
    d = max([sum(y <= t for y in adj) / len(adj) - sum(y <= t for y in mid) / len(mid) for t in [*mid, *adj]] + [0])
    return math.exp(-2 * d * d * len(mid) * len(adj) / (len(mid) + len(adj)))


def test_rank_tests(spark):
    rng = np.random.default_rng(8)
    rows = [([5.0, 6.0, 7.0, 8.0, 9.0], [1.0, 2.0, 3.0, 4.0]), ([1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0, 9.0]), ([1.0] * 4, [1.0] * 4), ([0.0] * 30, [1.0] * 40)]
    rows += [((rng.integers(0, 6, rng.integers(1, 20)) / 5).tolist(), (rng.integers(0, 6, rng.integers(1, 20)) / 5).tolist()) for _ in range(40)]
    d = spark.createDataFrame([*rows, ([], [1.0]), (None, [1.0])], "m array<double>, a array<double>")
    got = d.select("m", "a", L.rank_sum_p(F.col("m"), F.col("a")).alias("r"), L.ks_p(F.col("m"), F.col("a")).alias("k")).collect()
    assert [(r.r, r.k) for r in got[-2:]] == [(None, None)] * 2
    for r, (m, a) in zip(got, rows):
        assert r.r == pytest.approx(plain_rank(m, a), rel=1e-9, abs=1e-15) and r.k == pytest.approx(plain_ks(m, a), rel=1e-12)
    assert got[0].r == pytest.approx(0.0099, abs=2e-3) and got[1].r > 0.98 and got[2].r == 1.0
    assert got[0].k == pytest.approx(math.exp(-2 * 20 / 9), rel=1e-9)


def test_ks_work_per_value(spark):
    """Long arrays with many ties: one walk over both, not a count of both for each value."""
    rng = np.random.default_rng(3)
    sides = [((rng.integers(0, 900, 20_000) / 900).tolist(), (rng.integers(0, 800, 15_000) / 900).tolist()), ([0.5, None, 0.7], [0.1, 0.5, None, 0.2])]
    d = spark.createDataFrame(sides, "m array<double>, a array<double>")
    began = time.time()
    got = [r.k for r in d.select(L.ks_p(F.col("m"), F.col("a")).alias("k")).collect()]
    assert time.time() - began < 30
    m, a = map(np.sort, sides[0])
    top = max((np.searchsorted(a, t, "right") / 15_000 - np.searchsorted(m, t, "right") / 20_000) for t in [*m, *a])
    assert got[0] == pytest.approx(math.exp(-2 * top * top * 20_000 * 15_000 / 35_000), rel=1e-9)
    assert got[1] == pytest.approx(math.exp(-2 * (2 / 4) ** 2 * 3 * 4 / 7), rel=1e-12)  # missing values count in the sizes only


def test_priors_sum_to_one():
    for ref in "ACGT":
        known = [g for g in G.GENOTYPES if ref in g]
        assert G.prior_value(ref, ref * 2, 1e-3, 2.0) == pytest.approx(0.9985)
        assert sum(G.prior_value(ref, g, 1e-3, 2.0) for g in known) < 1.01


def plain_clusters(rows, dist, size):
    want, cur = [], None
    for (c, s, e), n in sorted(Counter((r[1], r[2], r[3]) for r in rows).items()):  # copies of a span stay together
        if cur and c == cur[0] and s - cur[2] <= dist and e - cur[1] <= size:
            cur = [c, cur[1], max(cur[2], e), cur[3] + n]
        else:
            if cur:
                want.append(tuple(cur))
            cur = [c, s, e, n]
    return sorted([*want, tuple(cur)] if cur else want)


def capped(spark, rows, dist, size):
    f = spark.createDataFrame(rows, "feat_id int, chrom string, start_pos int, end_pos int")
    return sorted((r.chrom, r.start_pos, r.end_pos, r.n) for r in W.cluster(f, dist, max_size=size).collect())


@pytest.mark.parametrize("seed, dist, size, span, length", [(1, 5, 80, 3000, 30), (2, 0, 1, 50, 4), (3, 40, 200, 400_000, 500), (4, 7, 40_000, 300_000, 9000), (5, 3, 60, 200, 90)])
def test_capped_clusters(spark, seed, dist, size, span, length):
    rng = np.random.default_rng(seed)
    rows = [(i, f"chr{i % 2}", int(s), int(s) + int(n)) for i, (s, n) in enumerate(zip(rng.integers(1, span, 1500), rng.integers(1, length, 1500)))]
    assert capped(spark, rows, dist, size) == plain_clusters(rows, dist, size)


def test_one_chain_in_many_tiles(spark):
    """Every span chains to the next one over 60 tiles; the walk is a path of ten thousand clusters."""
    rows = [(i, "x", 1 + 10 * i, 1 + 10 * i + 9 + i * 7 % 13) for i in range(100_000)]
    got = capped(spark, rows, 2, 95)
    assert got == plain_clusters(rows, 2, 95) and len(got) > 10_000


def test_read_lanes(spark):
    rng = np.random.default_rng(2)
    rows = [("chr1", i, int(s), int(s) + int(n)) for i, (s, n) in enumerate(zip(rng.integers(1, 500, 200), rng.integers(5, 40, 200)))]
    r = spark.createDataFrame(rows, "chrom string, read_id int, start_pos int, end_pos int")
    by = {}
    for x in L.read_lanes(r).collect():
        by.setdefault(x.lane, []).append((x.start_pos, x.end_pos))
    assert sum(map(len, by.values())) == 200
    for spans in by.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    depth = max(sum(s <= p <= e for _, _, s, e in rows) for p in range(1, 540))
    assert len(by) == depth


def test_sampling_invariants(spark):
    d = spark.range(2000).select(F.lit("A").alias("sample"), F.concat(F.lit("chr"), (F.col("id") % 3).cast("string")).alias("chrom"),
                                 F.col("id").cast("int").alias("chrom_pos"), (F.col("id") * 7 % 101).alias("v"))
    s = U.shuffle_values(d, ["v"], ["sample", "chrom"], "chrom_pos", 1)
    count = lambda x: sorted(map(tuple, x.groupBy("chrom", "v").count().collect()))
    assert count(s) == count(d) and s.select("chrom_pos").distinct().count() == 2000
    assert s.join(d, ["chrom", "chrom_pos", "v"]).count() < 500
    ranks = U.spread_rank(d, ["chrom"], F.xxhash64("chrom_pos"), 16).groupBy("chrom").agg(F.countDistinct("rank").alias("n"), F.max("rank").alias("m"), F.count("*").alias("k")).collect()
    assert all(r.n == r.m == r.k for r in ranks)
    thin = U.downsample_counts(d, 0.25, 3, ["v"], ["chrom", "chrom_pos"]).agg(F.sum("v")).first()[0] / d.agg(F.sum("v")).first()[0]
    assert 0.24 < thin < 0.26
    f = d.select(F.col("chrom_pos").alias("feat_id"), "chrom", F.lit(5).alias("start_pos"), (F.lit(5) + F.col("v")).alias("end_pos"))
    sizes = spark.createDataFrame([("chr0", 90), ("chr1", 1000), ("chr2", 300)], "chrom string, length bigint")
    moved = U.random_intervals(f, sizes, 4).join(sizes, "chrom")
    assert moved.count() == 2000 and moved.filter("start_pos < 1 or end_pos > length").count() == 0
    assert moved.select("chrom").distinct().count() == 3
