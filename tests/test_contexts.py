"""Contexts, type states and known variants by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lociframe.operators import contexts as X
from lociframe.operators import genotype as G
from lociframe.operators.tiles import TILE

COMP = str.maketrans("ACGTN", "TGCAN")


def genome(seed):
    """Reference bases with gaps, across a tile border."""
    rng = random.Random(seed)
    return {("x", p): rng.choice("ACGT") for p in range(TILE - 150, TILE + 150) if rng.random() < 0.95} | {("y", p): rng.choice("CG") for p in range(1, 40)}


def plain_context(ref, chrom, pos):
    five = "".join(ref.get((chrom, pos + k), "N") for k in range(-2, 3))
    return ("+", five) if ref[chrom, pos] == "C" else ("-", five.translate(COMP)[::-1])


def test_reference_contexts(spark):
    ref = genome(1)
    d = spark.createDataFrame([(c, p, b) for (c, p), b in ref.items()], "chrom string, pos long, ref_base string")
    got = {(r.chrom, r.pos): (r.strand, r.context) for r in X.reference_contexts(d).collect()}
    assert got == {(c, p): plain_context(ref, c, p) for (c, p), b in ref.items() if b in "CG"}


def test_states_add_up(spark):
    ref, rng = genome(2), random.Random(3)
    rows = [(c, p, *plain_context(ref, c, p), rng.randrange(5), rng.randrange(4)) for (c, p), b in ref.items() if b in "CG"]
    d = spark.createDataFrame(rows, "chrom string, pos long, strand string, context string, c_reads long, t_reads long")
    one = {r.type: r for r in X.type_levels(X.type_state(d)).collect()}
    parts = [X.type_state(d.filter(F.col("pos") % 3 == k)) for k in range(4)]  # the last one is empty
    merged = {r.type: r for r in X.type_levels(X.merge_states(parts)).collect()}
    shapes = {"CG": "..CG.", "CH": "..C[ACT].", "CHG": "..C[ACT]G", "CHH": "..C[ACT][ACT]", "GCH": ".GC[ACT].", "HCG": ".[ACT]CG.", "GCG": ".GCG.", "HCH": ".[ACT]C[ACT]."}
    assert set(one) == set(shapes)
    for name, shape in shapes.items():
        mine = [(r[4], r[5]) for r in rows if re.fullmatch(shape, r[3]) and r[4] + r[5]]
        c, t = sum(x for x, _ in mine), sum(y for _, y in mine)
        for r in (one[name], merged[name]):
            assert (r.n_positions, r.c_reads, r.t_reads) == (len(mine), c, t)
            assert r.mean_meth == pytest.approx(sum(x / (x + y) for x, y in mine) / len(mine)) and r.read_meth == pytest.approx(c / (c + t))
    empty = X.type_levels(X.type_state(d.limit(0))).collect()
    assert all(r.n_positions == 0 and r.mean_meth is None for r in empty)


def test_gpc_table(spark):
    calls = [("x", 5, "+", "C", "G", "G", False, "G", "A"), ("x", 5, "+", "T", "A", "G", False, "G", "A"), ("x", 5, "+", "C", None, "T", True, "G", "A"), ("x", 9, "-", "T", None, None, False, "G", "G")]
    d = spark.createDataFrame(calls, "chrom string, chrom_pos long, strand string, base string, prev_base string, next_base string, in_zone boolean, prev_ref string, next_ref string")
    got = {r.chrom_pos: r for r in X.gpc_table(d).collect()}
    assert (got[5].c_reads, got[5].t_reads, got[5].prev_base_g, got[5].prev_base_total, got[5].next_base_g, got[5].next_base_total) == (1, 1, 1, 2, 2, 3)
    assert (got[5].gch_weight, got[5].gcg_weight, got[5].hcg_weight) == pytest.approx((0.5 / 3, 1 / 3, 1 / 3))
    assert got[9].gch_weight is None
    assert [r.chrom_pos for r in X.gpc_only(X.gpc_table(d)).collect()] == [5]


def test_known_sites_have_their_own_prior(spark):
    """Weak evidence for a variant is called at a known site only; repeats of the site change nothing."""
    reads = [("x", p, "G", "+", b, 20) for p in (1, 2) for b in "GGAA"]
    d = spark.createDataFrame(reads, "chrom string, pos long, ref_base string, strand string, base string, qual int")
    likes = G.genotype_likelihoods(d)
    sites = spark.createDataFrame([("x", 2), ("x", 2), ("x", 7), (None, 1)], "chrom string, pos long")
    got = {r.pos: r for r in G.call_with_known(likes, sites).collect()}
    assert (got[1].known, got[2].known) == (False, True) and len(got) == 2
    plain = {r.pos: r.ratio for r in G.call_genotypes(likes).collect()}
    assert got[1].ratio == pytest.approx(plain[1])
    wide = {r.pos: r.ratio for r in G.call_genotypes(likes, het=G.KNOWN_HETEROZYGOSITY).collect()}
    assert got[2].ratio == pytest.approx(wide[2]) and got[2].genotype == "AG"
