"""Tiled work equals the same work in one window per group, whatever the tile width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lociframe.operators import joins as J
from lociframe.operators import rangejoin as R
from lociframe.operators import tiles as T
from lociframe.operators import walks as W


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(3)
    rows = []
    for chrom, top, n in (("chr1", 3000, 300), ("chr2", 90000, 60), ("chr3", 40, 25)):
        rows += [(chrom, p, rnd.randint(0, 9)) for p in sorted(rnd.sample(range(1, top), n))]
    return spark.createDataFrame(rows, "chrom string, pos int, v int").cache()


@pytest.fixture(scope="module")
def spans(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(250):
        s = rnd.randint(1, 2000)
        rows.append((i, rnd.choice(["chr1", "chr2"]), s, s + rnd.choice([0, 1, 5, 40, 300 if i % 50 == 0 else 8]), rnd.choice("+-.")))
    rows += [(1000 + i, "chr1", 777, 790, "+") for i in range(100)]  # copies of one locus
    return spark.createDataFrame(rows, "feat_id int, chrom string, start_pos int, end_pos int, strand string").cache()


def collect(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("width", [16, 64, 1 << 20])
def test_row_halo_lag_lead(points, width):
    h = T.row_halo(points, ["chrom"], "pos", 3, 2, width=width)
    w = T.tile_window(["chrom"], "pos")
    got = h.select("chrom", "pos", "_home", F.lag("pos", 3).over(w).alias("a"), F.lead("v", 2).over(w).alias("b")).filter("_home").drop("_home")
    one = Window.partitionBy("chrom").orderBy("pos")
    want = points.select("chrom", "pos", F.lag("pos", 3).over(one), F.lead("v", 2).over(one))
    assert collect(got) == collect(want)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(points, inclusive):
    got = T.running(points, ["chrom"], "pos", inclusive=inclusive, width=32, sums={"s": F.col("v")}, maxes={"m": F.col("v")})
    one = Window.partitionBy("chrom").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = points.select("chrom", "pos", F.sum("v").over(one), F.max("v").over(one))
    assert collect(got.select("chrom", "pos", "s", "m")) == collect(want)


def test_islands_and_cover(spans):
    rows = sorted((r.chrom, r.start_pos, r.end_pos) for r in spans.collect())
    merged, want = [], set()
    for c, s, e in rows:
        if merged and merged[-1][0] == c and s <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([c, s, e])
    want = {tuple(m) for m in merged}
    got = {tuple(r) for r in T.merge_intervals(spans, ["chrom"]).collect()}
    assert got == want
    bases = lambda rs: {(c, p) for c, s, e in rs for p in range(s, e + 1)}
    pieces = [tuple(r) for r in T.cover_pieces(spans, ["chrom"], width=32).collect()]
    assert bases(pieces) == bases(want)
    assert sum(e - s + 1 for _, s, e in pieces) == len(bases(want))


@pytest.mark.parametrize("width", [80, 1 << 20])
def test_scan_windows_width(points, width):
    got = W.scan_windows(points, 60, 3, {"s": F.col("v")}, ["chrom"], "pos", {"x": F.col("v")}, width=width)
    want = set()
    by = {}
    for r in points.collect():
        by.setdefault(r.chrom, []).append((r.pos, r.v))
    for chrom, rows in by.items():
        rows.sort()
        win = []
        for p, v in rows:  # the eviction rule read row by row
            win.append((p, v))
            while len(win) > 1 and p - win[1][0] >= 60:
                win.pop(0)
            if len(win) >= 3 and p - win[0][0] >= 60:
                vs = [x for _, x in win]
                want.add((chrom, win[0][0], p, len(win), float(sum(vs)), min(vs), max(vs)))
    got = {(r.chrom, r.start_pos, r.end_pos, r.n, r.s, r.x_min, r.x_max) for r in got.collect()}
    assert got == want and want


def test_variable_windows(points):
    got = W.scan_windows_variable(points, 20, 400, 3, {"s": F.col("v").cast("double")}, ["chrom"], "pos", width=512)
    by, want = {}, set()
    for r in points.collect():
        by.setdefault(r.chrom, []).append((r.pos, r.v))
    for chrom, rows in by.items():
        rows.sort()
        for k, (p, _) in enumerate(rows):
            back = [(q, v) for q, v in rows[:k + 1] if p - q < 400][::-1]
            if len(back) < 3:
                continue
            i, reached, total = 0, False, 0
            while i < len(back) and not (reached and i > 3):
                total += back[i][1]
                reached = p - back[i][0] >= 20
                i += 1
            if reached and i > 3:
                want.add((chrom, back[i - 2][0], p, i - 1, float(total)))
    assert {(r.chrom, r.start_pos, r.end_pos, r.n, r.s) for r in got.collect()} == want and want


def test_interval_sums_and_counts(points, spans):
    pts, fs = points.collect(), spans.collect()
    got = {r.feat_id: (r.n, r.t) for r in R.interval_sums(points, spans, {"n": F.lit(1), "t": F.col("v")}, "pos").collect()}
    for f in fs:
        hit = [p.v for p in pts if p.chrom == f.chrom and f.start_pos <= p.pos <= f.end_pos]
        assert got[f.feat_id] == (len(hit), sum(hit))
    cnt = {r.feat_id: r.n_overlaps for r in R.overlap_count(spans, spans.filter("strand = '+'"), flank=3).collect()}
    for f in fs:
        assert cnt[f.feat_id] == sum(g.strand == "+" and g.chrom == f.chrom and g.start_pos <= f.end_pos + 3 and g.end_pos >= f.start_pos - 3 for g in fs)


def test_overlap_filter_small_tiles(spans):
    a, b = spans.filter("strand = '-'"), spans.filter("strand = '+' and feat_id % 3 = 0")
    keys = a.select("chrom", "start_pos", "end_pos").distinct()
    got = {tuple(r) for r in J.spans_meeting(keys, b.select("chrom", "start_pos", "end_pos"), ["chrom"], width=16).collect()}
    bs = b.collect()
    want = {(r.chrom, r.start_pos, r.end_pos) for r in keys.collect()
            if any(g.chrom == r.chrom and g.start_pos <= r.end_pos and g.end_pos >= r.start_pos for g in bs)}
    assert got == want


def test_nearest_brute(spans):
    t, f = spans.filter("feat_id % 2 = 0"), spans.filter("feat_id % 2 = 1").withColumn("start_pos", F.col("start_pos") * 2).withColumn("end_pos", F.col("end_pos") * 2)
    fs = f.collect()
    for r in J.nearest(t, f).collect():
        best = None
        for g in fs:
            if g.chrom != r.chrom:
                continue
            d = r.end_pos - g.start_pos if g.start_pos > r.end_pos else (r.start_pos - g.end_pos if g.end_pos < r.start_pos else 0)
            d = -d if g.strand == "-" else d
            cand = (abs(d), g.start_pos, -g.end_pos, g.feat_id, d)
            best = cand if best is None or cand < best else best
        assert (r.near_id, r.dist) == (best[3], best[4])


def test_interval_sums_in_small_parts(spark, points, spans, monkeypatch):
    """Tasks follow the rows, also where Spark would join small partitions; repeated and missing places."""
    per = points.withColumn("sample", F.when(F.col("v") % 3 > 0, "A").otherwise("B"))
    lost = spark.createDataFrame([(None, 5, 9, "A"), ("chr1", None, 9, "A"), ("chr3", 7, None, "B"), ("chr3", 7, 4, None)], "chrom string, pos int, v int, sample string")
    pts, asks = per.unionByName(per).unionByName(lost), spans.unionByName(spans.limit(5)).select("feat_id", "chrom", "start_pos", "end_pos")
    asks = asks.unionByName(spark.createDataFrame([(-1, None, 1, 5), (-2, "chr1", None, 5)], asks.schema))
    rows, want = pts.collect(), []
    for f in asks.collect():
        for s in "AB" if f.chrom is not None and f.start_pos is not None else ():
            hit = [p.v for p in rows if (p.chrom, p.sample) == (f.chrom, s) and p.pos is not None and f.start_pos <= p.pos <= f.end_pos]
            want.append((f.feat_id, s, len(hit), sum(v or 0 for v in hit)))
    monkeypatch.setattr(R, "PART_ROWS", 64, raising=False)
    got = R.interval_sums(pts, asks, {"n": F.lit(1), "t": F.col("v")}, "pos", per="sample", per_values=["A", "B"])
    assert got.rdd.getNumPartitions() >= (len(rows) + 4 * asks.count()) // 64
    assert sorted(got.select("feat_id", "sample", "n", "t").collect()) == sorted(want)
    assert R.parts_of(spark, 10**6) == 10**6 // 64


def test_cytosines_dealt_by_rows(spark, monkeypatch, tmp_path):
    """The view in tasks that follow the rows gives the rows of the view, in one exchange."""
    from lociframe.plans.registry import Views

    rnd = random.Random(5)
    rows = [(rnd.randint(1, 90), rnd.choice([None, 7, 8, 9]), rnd.randint(1, 7), float(rnd.randint(1, 50)), rnd.random() * 900, rnd.random() / 10, rnd.random() / 10,
             rnd.choice("ARN"), rnd.choice(["F", "O", None])) for _ in range(3000)]
    rows += [(None, 7, 1, 3.0, 4.0, 0.1, 0.1, "R", "F")] * 2 + [(5, 7, None, 3.0, None, 0.1, 0.1, "R", "F")]
    names = "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(R, "PART_ROWS", 100, raising=False)
    v = Views(spark, str(tmp_path))
    got = v.dealt_cytosine()
    whole = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got.columns == v.cytosine.columns and whole(got) == whole(v.cytosine)
    assert got.groupBy("chrom", "sample", "chrom_pos").count().rdd.getNumPartitions() == 31
