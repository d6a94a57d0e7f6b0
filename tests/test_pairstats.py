"""CpG pair records by brute force over read bases."""

import random

import pytest

from lociframe.operators import pairstats as P
from lociframe.operators.tiles import TILE

COMP = {"A": "T", "C": "G", "G": "C", "T": "A"}


def reads(seed):
    """Base rows over a reference with many CGs, near a tile border too; some places lack one side."""
    rng = random.Random(seed)
    rows, rid = [], 0
    for chrom, origin in (("x", 1), ("y", TILE - 20)):
        ref = "".join(rng.choices("CCGGAT", k=45))
        for _ in range(60):
            start, strand, rid = rng.randrange(35), rng.choice("+-"), rid + 1
            for off in range(rng.randrange(1, 10)):
                if start + off < len(ref):
                    base = ref[start + off] if rng.random() < 0.6 else rng.choice("ACGT")
                    rows.append((rid, chrom, origin + start + off, strand, off + 1 if strand == "+" else 60 - off, ref[start + off], base))
    return rows


def mean(c, t):
    return c / (c + t) if c + t else None


def record(rows, chrom, pos):
    """The statistics of one pair by the letter, or None."""
    out, seen = {}, {}
    for side, p, ref in (("fw", pos, "C"), ("rev", pos + 1, "G")):
        here = sorted(r for r in rows if r[1] == chrom and r[2] == p and r[5] == ref)
        if not here:
            return None
        flip = (lambda b: COMP[b]) if side == "rev" else (lambda b: b)
        own = "+" if side == "fw" else "-"
        once = [r for k, r in enumerate(here) if not any(q[3:5] == r[3:5] for q in here[:k])]
        seen[side] = here
        for kind, part in (("", here), ("_collapsed", once)):
            mine = [flip(r[6]) for r in part if r[3] == own]
            other = [flip(r[6]) for r in part if r[3] != own]
            bad = sum(b in "GA" for b in mine + other) + other.count("T")
            good = mine.count("C") + other.count("C")
            out[f"{side}_depth{kind}"] = len(mine)
            out[f"{side}_meth{kind}"] = mean(mine.count("C"), mine.count("T"))
            out[f"{side}_snp{kind}"] = mean(bad, good)
    f, r = out["fw_depth"], out["rev_depth"]
    out["meth_overall"] = ((out["fw_meth"] or 0) * f + (out["rev_meth"] or 0) * r) / (f + r) if f + r else 0.0
    for k, (side, strand, flip) in enumerate((("fw", "+", False), ("rev", "+", False), ("rev", "-", True), ("fw", "-", True)), 1):
        found = [COMP[x[6]] if flip else x[6] for x in seen[side] if x[3] == strand]
        out |= {f"snv{k}_{b.lower()}": found.count(b) for b in "ACTG"}
    return out


def same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v)), k


@pytest.fixture(scope="module")
def pairs(spark):
    rows = reads(1)
    d = spark.createDataFrame(rows, "read_id long, chrom string, pos long, strand string, cycle int, ref_base string, base string").repartition(5)
    return rows, P.pair_statistics(P.pair_state(d)).persist()


def test_records(pairs):
    rows, d = pairs
    assert len(P.STATS) == 29
    got = {(r.chrom, r.pos): r.asDict() for r in d.collect()}
    want = {(c, p): x for c, p in {(r[1], r[2]) for r in rows if r[5] == "C"} if (x := record(rows, c, p))}
    assert set(got) == set(want) and len(want) > 5
    for k, x in want.items():
        same({s: got[k][s] for s in P.STATS}, x)


def test_variants_and_windows(pairs):
    rows, d = pairs
    all_rows = [r.asDict() for r in d.collect()]
    middle = sorted(r["fw_snp"] or 0 for r in all_rows)[-3]  # a share that occurs
    for fw, rev in ((0.1, 0.1), (middle, 1.0), (1.1, middle)):
        kept = {(r.chrom, r.pos) for r in P.without_variants(d, fw, rev).collect()}
        assert kept == {(r["chrom"], r["pos"]) for r in all_rows if not ((r["fw_snp"] or 0) >= fw or (r["rev_snp"] or 0) > rev)}
    assert 0 < len(kept) < len(all_rows)
    for size in (1, 12, TILE * 2):
        for r in P.trailing_windows(d, size, P.STATS).collect():
            near = [x for x in all_rows if x["chrom"] == r.chrom and 0 <= r.pos - x["pos"] < size]
            assert r.n_before == len(near) - 1
            for s in P.STATS:
                have = [x[s] for x in near if x[s] is not None]
                assert r[f"mean_{s}"] == (pytest.approx(sum(have) / len(have)) if have else None)


def test_cycle_shift(spark):
    rows = reads(3)
    d = spark.createDataFrame(rows, "read_id long, chrom string, pos long, strand string, cycle int, ref_base string, base string")
    for strand, ref, t in (("+", "C", "T"), ("-", "G", "A")):
        spans = ((1, 3), (4, 9)) if strand == "+" else ((51, 55), (56, 60))
        got = {(r.chrom, r.pos): r for r in P.cycle_shift(d, 15, *spans, strand).collect()}
        want = {}
        mine = [r for r in rows if r[3] == strand and r[5] == ref]
        for chrom, pos in {(r[1], r[2]) for r in mine}:
            near = [r for r in mine if r[1] == chrom and 0 <= pos - r[2] < 15]
            shares = [mean(sum(r[6] == t for r in near if a <= r[4] <= b), sum(r[6] == ref for r in near if a <= r[4] <= b)) for a, b in spans]
            if None not in shares and 0 < abs(shares[1] - shares[0]) < 1:
                want[chrom, pos] = shares
        assert set(got) == set(want) and want
        for k, (low, medium) in want.items():
            assert (got[k].low_share, got[k].medium_share, got[k].shift) == pytest.approx((low, medium, medium - low))
