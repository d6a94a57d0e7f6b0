"""Overlaps of many types against brute force, across tile borders and with copies."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lociframe.operators import aggregates as A
from lociframe.operators import overlaps as O
from lociframe.operators.tiles import TILE

TYPES = ["a", "b", "c", "d", "e"]


def rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.choice([rng.randrange(1, 60), TILE - rng.randrange(40), 3 * TILE + rng.randrange(30)])
        out.append((i, rng.choice(TYPES[:4]), rng.choice(["x", "y"]), start, start + rng.choice([0, 1, 5, 20, 2 * TILE]), rng.choice("+-.")))
    return out + [(n + k, *r[1:]) for k, r in enumerate(out[:5])]


def frame(spark, data):
    return spark.createDataFrame(data, "feat_id long, feat_type string, chrom string, start_pos int, end_pos int, strand string")


def meet(group):
    return len({f[2] for f in group}) == 1 and max(f[3] for f in group) <= min(f[4] for f in group)


def test_combinations(spark):
    data = rows(1, 60)
    got = {tuple(r.types): (int(r.n), r.bases) for r in O.combination_counts(frame(spark, data), TYPES).collect()}
    by = {t: [f for f in data if f[1] == t] for t in TYPES}
    covered = {t: {(f[2], p) for f in by[t] for p in range(f[3], f[4] + 1)} for t in TYPES}
    assert set(got) == set(O.choices(TYPES)) and len(got) == 10 + 10 + 5
    for combo in got:
        n = sum(map(meet, product(*[by[t] for t in combo])))
        assert got[combo] == (n, len(set.intersection(*[covered[t] for t in combo]))), combo
    master = {tuple(r.types): int(r.n) for r in O.combination_counts(frame(spark, data), TYPES, master="c").collect()}
    assert master == {("c", t): sum(map(meet, product(by["c"], by[t]))) for t in TYPES if t != "c"}
    assert all(r.n == 0 and r.bases == 0 for r in O.combination_counts(frame(spark, []), TYPES).collect())


def test_many_copies_count_as_products(spark):
    """Tuples of a hot place are counted, not formed."""
    f = spark.range(40_000).select(F.col("id").alias("feat_id"), F.element_at(F.array(*map(F.lit, TYPES[:4])), (F.col("id") % 4 + 1).cast("int")).alias("feat_type"),
                                   F.lit("x").alias("chrom"), F.lit(5).alias("start_pos"), F.lit(9).alias("end_pos"), F.lit("+").alias("strand"))
    got = {tuple(r.types): (int(r.n), r.bases) for r in O.combination_counts(f, TYPES[:4]).collect()}
    assert got[tuple(TYPES[:4])] == (10_000**4, 5) and got["a", "b"] == (10_000**2, 5)


@pytest.mark.parametrize("flank", [0, 7, 10**6])
def test_feature_columns(spark, flank):
    data, targets = rows(2, 50), [(k, t[2], t[3] + k % 9, t[3] + k % 9 + k % 4) for k, t in enumerate(rows(3, 70))] + [(900, "z", 5, 9)]
    got = {r.feat_id: r for r in O.feature_columns(spark.createDataFrame(targets, "feat_id long, chrom string, start_pos int, end_pos int"), frame(spark, data), TYPES, flank).collect()}
    totals, lone = [0] * len(TYPES), 0
    for key, chrom, a, b in targets:
        want = []
        for t in TYPES:
            found = []
            for _, _, c, s, e, strand in (f for f in data if f[1] == t and f[2] == chrom):
                rank = "+-.".index(strand)
                if s > b:
                    found.append((s - b, 1, rank, -(s - b) if strand == "+" else s - b))
                elif e < a:
                    found.append((a - e, 0, rank, -(a - e) if strand == "-" else a - e))
                else:
                    found.append((0, 0, 0, 0))
            best = min(found, default=None)
            want.append(best[3] if best and best[0] <= flank else None)
        totals = [n + (d is not None) for n, d in zip(totals, want)]
        none = int(all(d is None for d in want))
        lone += none
        assert tuple(got[key])[1:] == (chrom, a, b, *[int(d is not None) for d in want], none) if flank == 0 else (chrom, a, b, *want, none), key
    assert tuple(got[None])[4:] == (*totals, lone)


def test_venn_of_cytosines(spark):
    data = rows(4, 80)
    rng = random.Random(5)
    cyt = [(rng.choice("AB"), rng.choice("xyz"), p, rng.choice("+-"), rng.randrange(9), rng.randrange(9)) for p in rng.sample([*range(1, 90), *range(TILE - 60, TILE + 60), *range(3 * TILE, 3 * TILE + 60)], 200)]
    got = {(r.sample, r.mask): (r.n, r.ct_reads) for r in A.cytosine_venn(spark.createDataFrame(cyt, "sample string, chrom string, chrom_pos int, strand string, c_reads long, t_reads long"), frame(spark, data), TYPES).collect()}
    want = {}
    for s, c, p, _, m, u in cyt:
        mask = sum(1 << i for i, t in enumerate(TYPES) if any(f[1] == t and f[2] == c and f[3] <= p <= f[4] for f in data))
        n, ct = want.get((s, mask), (0, 0))
        want[s, mask] = (n + 1, ct + m + u)
    assert got == want
