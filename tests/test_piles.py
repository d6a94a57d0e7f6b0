"""Reads dealt by tile give the rows that their bases would give, without an exchange of bases."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import aggregates as A
from lociframe.operators import genotype as G
from lociframe.operators import joins as J
from lociframe.operators import lookups
from lociframe.operators import walks as W
from lociframe.operators.piles import place, tiled_bases
from lociframe.plans.registry import near, near_double
from lociframe.plans.scans import call_columns, read_cytosines


@pytest.fixture(scope="module")
def reads(spark):
    rnd = random.Random(11)
    text = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    genome = text("ACGT", 400)
    rows = []
    for k in range(60):
        at, n = rnd.randint(1, 300), rnd.randint(1, 60)
        ref = genome[at - 1 : at - 1 + n]
        rows.append((k, rnd.choice(["chr1", "chr2"]), at, rnd.choice("+-"), 30, "".join(rnd.choice([b, b, b, "T"]) for b in ref), ref, text("5?+I", n)))
    rows += rows[:3] + [(None, None, None, "+", 30, "ACG", "ACG", "III")]  # repeats and a read without a place
    return spark.createDataFrame(rows, "read_id long, chrom string, start_pos long, strand string, mapq int, seq string, ref string, qual string").cache()


def plain(reads):
    d = reads.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("ref"))))
    at = lambda c: F.substring(F.col(c), F.col("i"), F.lit(1))
    return d.select("read_id", "chrom", (F.col("start_pos") + F.col("i") - 1).alias("pos"), "strand", at("ref").alias("ref_base"), at("seq").alias("base"), (F.ascii(at("qual")) - 33).alias("qual"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange")


@pytest.mark.parametrize("width", [16, 64, 1 << 12])
def test_bases_of_own_positions(reads, width):
    want = plain(reads)
    got = tiled_bases(reads, 3, width=width).filter("home").select(*want.columns)
    assert rows(got) == rows(want)
    assert rows(tiled_bases(reads, width=width).select(*want.columns)) == rows(want)


@pytest.mark.parametrize("width", [16, 1 << 12])
def test_position_sums_and_neighbours(reads, width):
    want = plain(reads)
    tiled = tiled_bases(reads, 2, width=width)
    assert rows(A.snp_calls(tiled.filter("home"), min_count=1).drop("tile", "home")) == rows(A.snp_calls(want, min_count=1))
    refs = want.select("chrom", "pos", "ref_base").distinct()
    dealt = tiled.select(*place(tiled, "ref_base")).distinct()
    around = lookups.base_neighbours(dealt, 2, 2)
    assert rows(around) == rows(lookups.base_neighbours(refs, 2, 2).select(*around.columns))


def test_bases_do_not_move(reads):
    """One exchange, that of the reads; the bases had one of their own for each grouping."""
    assert exchanges(G.genotype_likelihoods(tiled_bases(reads, parts=3))) == 1
    assert exchanges(A.snp_calls(tiled_bases(reads, parts=3))) == 1


def cytosine_calls(bases):
    k = read_cytosines(bases)
    return k.select("read_id", *[c for c in ("chrom", "tile", "home") if c in k.columns], "strand", "chrom_pos", (F.col("c_reads") > 0).alias("meth"))


def allele_bases(bases):
    call, n = call_columns()
    return bases.select("read_id", *place(bases), "strand", "base", call.alias("call"), n["c_reads"].alias("c"), n["t_reads"].alias("t"))


def plain_allele_counts(bases, dist):
    seen, reads, sums = {}, {}, {}
    for x in bases:
        seen.setdefault((x.chrom, x.pos), set()).add(x.base)
        reads.setdefault(x.read_id, []).append(x)
    for rows in reads.values():
        for x in rows:
            for y in rows if x.call and x.chrom is not None else ():
                if 0 < abs(x.pos - y.pos) <= dist and len(seen[y.chrom, y.pos]) > 1:
                    c, t = sums.get(k := (x.chrom, x.pos, x.strand, y.pos, y.base), (0, 0))
                    sums[k] = c + x.c, t + x.t
    return sorted([(*k, *v) for k, v in sums.items()], key=str)


@pytest.mark.parametrize("width", [16, 1 << 12])
def test_alleles_of_a_read(reads, width):
    """A read that comes twice meets its copy, as in a join by read; a read without a place has no variants."""
    want = plain_allele_counts(allele_bases(plain(reads)).collect(), 9)
    assert want and rows(J.allele_counts(allele_bases(tiled_bases(reads, 9, width=width)), 9)) == want
    assert rows(J.allele_counts(allele_bases(plain(reads)), 9)) == want


def plain_other_read(calls, dist):
    out = []
    for x in calls:
        for pos in sorted({y.chrom_pos for y in calls if x.chrom is not None and (y.chrom, y.strand) == (x.chrom, x.strand) and 0 < y.chrom_pos - x.chrom_pos <= dist}):
            there = sorted((y.read_id, y.meth) for y in calls if (y.chrom, y.strand, y.chrom_pos) == (x.chrom, x.strand, pos) and y.read_id != x.read_id)
            if there:
                out.append((x.chrom, x.strand, x.chrom_pos, pos, pos - x.chrom_pos, x.read_id, there[0][0], x.meth, there[0][1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [16, 1 << 12])
def test_pairs_of_different_reads(reads, width):
    once = reads.dropDuplicates(["read_id"])
    want = plain_other_read(cytosine_calls(plain(once)).collect(), 8)
    assert want and rows(J.read_pairs(cytosine_calls(tiled_bases(once, 8, width=width)), 8, "different")) == want
    assert rows(J.read_pairs(cytosine_calls(plain(once)), 8, "different")) == want


def test_pairs_do_not_move(reads):
    assert exchanges(J.allele_counts(allele_bases(tiled_bases(reads, 9, parts=3)), 9)) == 1
    assert exchanges(J.read_pairs(cytosine_calls(tiled_bases(reads, 8, parts=3)), 8, "different")) == 1


def test_centres_in_blocks(spark):
    top = 7 * (W.BLOCK * 3 + 5) + 2
    sizes = spark.createDataFrame([("chr1", top), ("chr2", 1), ("chr3", None)], "chrom string, length long")
    got = W.stepped_centres(sizes, 7)
    assert rows(got.select("chrom", "centre")) == sorted([("chr1", c) for c in range(1, top + 1, 7)] + [("chr2", 1)], key=str)
    assert rows(got.groupBy("chrom").agg(F.max("chrom_end"))) == [("chr1", top), ("chr2", 1)]
    assert exchanges(got) == 1


def test_rounding_of_doubles(spark):
    values = [0.0, -0.0, 1.234565, -1.234565, -0.0000004, 3.5e6, -12.345675, 98765.432105, None]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    assert [str(r[0]) for r in d.select(near_double(F.col("v"), 5)).collect()] == [str(r[0]) for r in d.select(near(F.col("v"), 5)).collect()]
