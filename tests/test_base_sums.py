"""Likelihoods summed from dealt reads are those of their bases, also for odd reads and over many batches."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import genotype as G
from lociframe.operators import lookups
from lociframe.operators.piles import tiled_bases

SCHEMA = "read_id long, chrom string, start_pos long, strand string, mapq int, seq string, ref string, qual string"


@pytest.fixture(scope="module")
def reads(spark):
    rnd = random.Random(7)
    text = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    genome = text("ACGTACGTACGTN", 300)
    rows = []
    for k in range(80):
        at, n = rnd.randint(1, 220), rnd.randint(1, 60)
        ref = genome[at - 1 : at - 1 + n]
        rows.append((k, rnd.choice(["chr1", "chr2", None]), at, rnd.choice(["+", "-", "+", "-", None, "."]), 30, "".join(rnd.choice([b, b, b, "T", "A", "n"]) for b in ref), ref, text("!5?+I~", n)))
    rows += rows[:3] + [(90, None, None, "+", 30, "ACG", "ACG", "III"), (91, "chr1", None, "-", 30, "ACG", "TCG", "III"), (92, "chr1", 5, "+", 30, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def odd(spark, reads):
    """Texts that are null, shorter than the reference or not ASCII."""
    rows = [(100, "chr1", 9, "+", 30, None, "ACGTACGT", "IIIIIIII"), (101, "chr1", 10, "-", 30, "AC", "ACGTACGT", "II"), (102, "chr1", 12, "+", 30, "ACGTACGT", "ACGTACGT", None),
            (103, "chr1", 12, "-", 30, "ACGé", "ACéT", "Ié5I"), (104, "chr2", 12, "+", 30, "ACGT", None, "IIII"), (105, "chr9", 1, "+", 30, "AC", "AC", None)]
    return reads.unionByName(spark.createDataFrame(rows, SCHEMA)).cache()


def plain(bases):
    """The same bases without the reads behind them."""
    return bases.select("*")


def table(df):
    keys = [c for c in ("chrom", "tile", "home", "pos", "ref_base") if c in df.columns]
    values = [c for c in df.columns if c not in keys]
    return {tuple(r[k] for k in keys): [r[v] for v in values] for r in df.collect()}


def assert_alike(got, want):
    a, b = table(got), table(want)
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString() and a.keys() == b.keys()
    for k, v in a.items():
        assert [x is None for x in v] == [x is None for x in b[k]], k
        assert [x for x in v if x is not None] == pytest.approx([x for x in b[k] if x is not None], rel=1e-12, abs=1e-12), k


@pytest.mark.parametrize("width, halo", [(16, 0), (16, 2), (64, 0), (1 << 12, 2)])
def test_sums_of_reads(reads, width, halo):
    b = tiled_bases(reads, halo, width=width)
    assert_alike(G.genotype_likelihoods(b, by_strand=True), G.genotype_likelihoods(plain(b), by_strand=True))
    assert_alike(G.genotype_likelihoods(b, 0.2, 0.9, 0.1), G.genotype_likelihoods(plain(b), 0.2, 0.9, 0.1))


def test_odd_texts(odd):
    b = tiled_bases(odd, width=32)
    assert_alike(G.genotype_likelihoods(b, by_strand=True), G.genotype_likelihoods(plain(b), by_strand=True))


@pytest.mark.parametrize("rows", [1, 3, 7])
def test_tiles_longer_than_a_batch(spark, odd, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        b = tiled_bases(odd, 2, parts=2, width=64)
        assert_alike(G.genotype_likelihoods(b, by_strand=True), G.genotype_likelihoods(plain(b), by_strand=True))
    finally:
        spark.conf.set(name, before)


def test_conditions_on_calls_stay_above_them(reads):
    """Pushed below the call, a condition worked out every posterior many times for each position."""
    calls = G.call_genotypes(G.genotype_likelihoods(tiled_bases(reads)))
    text = G.confident(calls, 0.01, variants_only=True).select("chrom", "pos", "genotype")._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in text.splitlines() if "Filter" in x and "ratio" in x]
    assert not [x for x in text.splitlines() if "Filter" in x and "greatest" in x]


def test_calls_rank_as_before(spark):
    """Ties go to the first genotype; where nothing is known the first two are named and the ratio is null."""
    like = lambda **x: tuple(x.get(g, -9.0) for g in G.GENOTYPES)
    rows = [("A", *like(GG=-1.0, TT=-1.0)), ("A", *[None] * 10), ("N", *like()), ("A", *[None] * 9, -1.0), ("A", -1.0, *[None] * 9), ("A", *like(AA=0.0, AG=0.0))]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, ref_base string, " + ", ".join(f"{g} double" for g in G.GENOTYPES))
    flat = {g: F.when(F.col("ref_base") == "A", F.lit(0.0)) for g in G.GENOTYPES}
    got = {r.pos: (r.genotype, r.runner_up, r.ratio) for r in G.call_genotypes(d, prior=flat).collect()}
    assert got == {0: ("GG", "TT", 0.0), 1: ("AA", "AC", None), 2: ("AA", "AC", None), 3: ("TT", "AA", None), 4: ("AA", "AC", None), 5: ("AA", "AG", 0.0)}


def test_likelihoods_stay_where_sites_are_joined(spark, reads):
    """What moves to the sites is the calls; the ten likelihoods moved before."""
    sites = spark.createDataFrame([("chr1", 20), ("chr2", 30), ("chr1", 20)], "chrom string, pos long")
    out = G.call_with_known(G.genotype_likelihoods(tiled_bases(reads)), sites.hint("merge")).select("chrom", "pos", "known", "depth", "genotype", "ratio")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = next(i for i, x in enumerate(plan.splitlines()) if "Join LeftOuter" in x)
    assert not any(f" {g}#" in plan.splitlines()[joined + 1] for g in G.GENOTYPES) and "MapInArrow" not in plan.splitlines()[joined + 1]
    got = {(r.chrom, r.pos): r.known for r in out.collect()}
    assert {k for k, v in got.items() if v} == {k for k in (("chr1", 20), ("chr2", 30)) if k in got}


@pytest.mark.parametrize("width, rows", [(16, 10000), (64, 5), (1 << 12, 10000)])
def test_neighbours_and_counts_come_with_the_sums(spark, odd, width, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        b = tiled_bases(odd, 2, width=width)
        keys = ["chrom", "tile", "home", "pos", "ref_base"]
        near = [f"ref_base_{k}" for k in ("m2", "m1", "p1", "p2")]
        like = G.genotype_likelihoods(b, around=2)
        want = lookups.base_neighbours(G.genotype_likelihoods(plain(b)).select(*keys), 2, 2)
        got = lookups.base_neighbours(like.select(*keys, *near), 2, 2)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        calls = [G.call_genotypes(x, prior=G.bisulfite_prior_columns(F.col("ref_base"))) for x in (like, G.genotype_likelihoods(plain(b)))]
        got, want = G.variant_methylation(b, calls[0].select(*keys, "genotype", *near)
                                          .withColumn("ratio", F.lit(1.0))), G.variant_methylation(plain(b), calls[1].select(*keys, "genotype").withColumn("ratio", F.lit(1.0)))
        assert got.columns == want.columns and got.count() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set(name, before)


def test_neighbours_do_not_move_positions(reads):
    calls = G.call_genotypes(G.genotype_likelihoods(tiled_bases(reads, 2, parts=3), around=2))
    plan = G.variant_classes(calls)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


@pytest.mark.parametrize("width, rows", [(16, 4), (64, 10000), (1 << 12, 7)])
def test_called_methylation_stays_in_its_tile(spark, odd, width, rows):
    """Reads of the same place with other reference bases count for each call there, as in the join with the bases."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        b, alone = tiled_bases(odd, 2, width=width), tiled_bases(odd).drop("tile")
        types = G.cytosine_types(G.call_genotypes(G.genotype_likelihoods(b, counts=True)))
        want = G.cytosine_types(G.call_genotypes(G.genotype_likelihoods(alone)))
        lines = lambda d: sorted(map(str, d.select("chrom", "pos", "strand", "type").collect()))
        assert want.count() and lines(types) == lines(want)
        assert lines(G.cytosine_types(G.call_genotypes(G.genotype_likelihoods(b)))) == lines(want)
        got, want = G.called_methylation(b, types), G.called_methylation(alone, want)
        assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set(name, before)


def test_called_methylation_moves_reads_and_cytosines_only(reads):
    b = tiled_bases(reads, 2, parts=3)
    out = G.called_methylation(b, G.cytosine_types(G.call_genotypes(G.genotype_likelihoods(b, counts=True))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan and "Window" not in plan
