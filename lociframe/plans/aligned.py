"""Feature alignments, nucleosome scores, depleted regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import methylation as M
from lociframe.operators import aggregates as A
from lociframe.operators import aligned as L
from lociframe.plans.aggregates import rounded
from lociframe.plans.joins import typed
from lociframe.plans.registry import question

BOTH = "v_cytosine v_feature"
KEYS = ("sample", "chrom")
FM = "c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE)"
OFF = f"""a AS (SELECT *, {{anchor}} AS a FROM v_feature), p AS (SELECT c.sample, a.feat_id, CASE WHEN a.strand = '-' THEN a.a - c.chrom_pos ELSE c.chrom_pos - a.a END AS off,
  c.strand = CASE WHEN a.strand = '-' THEN '-' ELSE '+' END AS same, {FM} AS m FROM v_cytosine c JOIN a ON a.chrom = c.chrom AND c.chrom_pos BETWEEN a.a - {{k}} AND a.a + {{k}})"""
MID = "CAST((start_pos + end_pos + 1) // 2 AS INT)"
TSS = "CASE WHEN strand = '-' THEN end_pos ELSE start_pos END"


@question("w_feat_align_avg", BOTH, f"""
WITH {OFF.format(anchor=MID, k=50)} SELECT sample, CAST(off AS INT) AS "offset", ROUND(SUM(m) FILTER (WHERE same), 4) AS own_sum, COUNT(m) FILTER (WHERE same) AS own_n,
  ROUND(SUM(m) FILTER (WHERE NOT same), 4) AS other_sum, COUNT(m) FILTER (WHERE NOT same) AS other_n FROM p GROUP BY 1, 2""")
def feat_align_avg(v):
    out = L.aligned_average(v.cytosine, v.feature, 50, "chrom_pos", M.frac_meth(), ["sample"])
    return rounded(out, "own_sum", "other_sum", digits=4).withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("own_n", "other_n")})


@question("w_feat_align_matrix", BOTH, f"""
WITH {OFF.format(anchor=TSS, k=30)}, c AS (SELECT feat_id, CAST(FLOOR((off + 30) * (10 / 61.0) + 0.5) AS INT) AS col, same, m, sample FROM p)
SELECT sample, feat_id, col, ROUND(SUM(m) FILTER (WHERE same), 6) AS own_sum, COUNT(m) FILTER (WHERE same) AS own_n, ROUND(SUM(m) FILTER (WHERE NOT same), 6) AS other_sum, COUNT(m) FILTER (WHERE NOT same) AS other_n
FROM c WHERE col >= 0 AND col < 10 GROUP BY 1, 2, 3""")
def feat_align_matrix(v):
    out = L.aligned_matrix(v.cytosine, v.feature, 30, "chrom_pos", M.frac_meth(), 10, "start", by=["sample"])
    return rounded(out, "own_sum", "other_sum").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("own_n", "other_n")})


@question("w_row_sort", BOTH, f"""
WITH {OFF.format(anchor=MID, k=30)}, c AS (SELECT sample, feat_id, off + 30 AS col, SUM(m) FILTER (WHERE same) AS o, SUM(m) FILTER (WHERE NOT same) AS q, COUNT(*) FILTER (WHERE same) AS no, COUNT(*) FILTER (WHERE NOT same) AS nq FROM p WHERE m IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT sample, feat_id, (coalesce(o, 0) + coalesce(q, 0)) / (CAST(no > 0 AS INT) + CAST(nq > 0 AS INT)) AS v, pow(greatest(abs(col - 31), 3) / 3.0, -0.5) AS w FROM c)
SELECT sample, feat_id, ROUND(SUM(v * w) / COUNT(*), 6) AS sort_value FROM v GROUP BY 1, 2""")
def row_sort(v):
    d = v.cytosine.filter(M.frac_meth().isNotNull())
    m = L.aligned_matrix(d, v.feature, 30, "chrom_pos", M.frac_meth(), by=["sample"])
    return rounded(L.row_scores(m, 61, -0.5, 3, by=["sample"]), "sort_value").orderBy("sample", "sort_value", "feat_id")


@question("w_matrix_downscale", BOTH, f"""
WITH {OFF.format(anchor=MID, k=30)}, c AS (SELECT sample, feat_id, off + 30 AS col, SUM(m) FILTER (WHERE same) AS o FROM p GROUP BY 1, 2, 3)
SELECT sample, feat_id, CAST(FLOOR(col * (6 / 61.0)) AS INT) AS col, ROUND(avg(o), 6) AS own_sum FROM c GROUP BY 1, 2, 3""")
def matrix_downscale(v):
    m = L.aligned_matrix(v.cytosine, v.feature, 30, "chrom_pos", M.frac_meth(), by=["sample"])
    return rounded(L.downscale(m, "feat_id", None, (61, 6), "own_sum", by=["sample"]), "own_sum")


@question("w_zero_out", BOTH, f"""
WITH {OFF.format(anchor=MID, k=20)}, c AS (SELECT sample, feat_id, CAST(off + 20 AS INT) AS col, SUM(m) FILTER (WHERE same) AS o, COUNT(m) FILTER (WHERE same) AS n FROM p GROUP BY 1, 2, 3)
SELECT sample, feat_id, col, CASE WHEN feat_id % 3 = 0 AND col >= 5 AND col < 15 THEN 0.0 ELSE ROUND(o, 6) END AS own_sum, CASE WHEN feat_id % 3 = 0 AND col >= 5 AND col < 15 THEN 0.0001 ELSE CAST(n AS DOUBLE) END AS own_n FROM c""")
def zero_out(v):
    m = L.aligned_matrix(v.cytosine, v.feature, 20, "chrom_pos", M.frac_meth(), by=["sample"])
    m = m.withColumn("own_n", F.coalesce("own_n", F.lit(0)))
    r = v.feature.filter(F.col("feat_id") % 3 == 0).select("feat_id", F.lit(5).alias("lo"), F.lit(15).alias("hi"))
    return rounded(L.zero_out(m, r), "own_sum").select("sample", "feat_id", "col", "own_sum", "own_n")


@question("w_phase_bins", BOTH, f"""
WITH {OFF.format(anchor=MID, k=50)} SELECT sample, feat_id, CAST(FLOOR((off + 50) / 20.0) AS INT) AS bin, ROUND(avg(m), 6) AS mean, COUNT(*) AS n FROM p WHERE m IS NOT NULL AND FLOOR((off + 50) / 20.0) < 5 GROUP BY 1, 2, 3""")
def phase_bins(v):
    return rounded(L.phase_bins(v.cytosine, typed(v, "1-URGENT").unionByName(v.feature.filter(F.col("feat_type") != "1-URGENT")), 50, 20, "chrom_pos", M.frac_meth(), ["sample"]), "mean")


NUC = """c AS (SELECT DISTINCT chrom, chrom_pos AS centre FROM v_cytosine), w AS (SELECT c.chrom, c.centre,
  COUNT(*) FILTER (WHERE r.strand = '+' AND r.start_pos BETWEEN centre - 93 AND centre - 53) AS pre, COUNT(*) FILTER (WHERE r.strand = '-' AND r.start_pos BETWEEN centre + 53 AND centre + 93) AS post,
  COUNT(*) FILTER (WHERE r.start_pos BETWEEN centre - 20 AND centre + 20) AS u0, COUNT(*) FILTER (WHERE r.start_pos BETWEEN centre - 205 AND centre - 165) + COUNT(*) FILTER (WHERE r.start_pos BETWEEN centre + 165 AND centre + 205) AS u1
  FROM c LEFT JOIN v_read r ON r.chrom = c.chrom AND r.start_pos BETWEEN centre - 205 AND centre + 205 GROUP BY 1, 2)"""


@question("w_nucleosome_score", "v_cytosine v_read", f"""
WITH {NUC} SELECT chrom, centre, pre, post, u0 + u1 AS unphased, ROUND(log2((pre + post + 0.2) / (u0 + u1 + 0.6) * 3.0), 6) AS score FROM w""")
def nucleosome_score(v):
    c = v.cytosine.select("chrom", F.col("chrom_pos").alias("centre"))
    return rounded(L.nucleosome_score(c, v.read), "score")


@question("w_nucleosome_min_diff", "v_cytosine v_read", f"WITH {NUC} SELECT chrom, centre, pre, post, u0 AS unphased, CAST(least(pre, post) - u0 AS DOUBLE) AS score FROM w")
def nucleosome_min_diff(v):
    return L.nucleosome_score(v.cytosine.select("chrom", F.col("chrom_pos").alias("centre")), v.read, metric="min_diff")


@question("w_ndr", "v_cytosine", f"""
WITH s AS (SELECT sample, chrom, chrom_pos, c_reads / CAST(c_reads + t_reads AS DOUBLE) AS m FROM v_cytosine WHERE c_reads + t_reads >= 2),
w AS (SELECT e.sample, e.chrom, e.chrom_pos AS p, avg(x.m) FILTER (WHERE x.chrom_pos BETWEEN e.chrom_pos - 59 AND e.chrom_pos) AS mid, COUNT(*) FILTER (WHERE x.chrom_pos BETWEEN e.chrom_pos - 59 AND e.chrom_pos) AS nm,
  avg(x.m) FILTER (WHERE x.chrom_pos < e.chrom_pos - 59) AS pre, COUNT(*) FILTER (WHERE x.chrom_pos < e.chrom_pos - 59) AS np, avg(x.m) FILTER (WHERE x.chrom_pos > e.chrom_pos) AS post, COUNT(*) FILTER (WHERE x.chrom_pos > e.chrom_pos) AS nq
  FROM s e JOIN s x ON x.sample = e.sample AND x.chrom = e.chrom AND x.chrom_pos BETWEEN e.chrom_pos - 79 AND e.chrom_pos + 20 GROUP BY 1, 2, 3),
g AS (SELECT sample, chrom, p - 59 AS s, p AS e FROM w WHERE nm >= 4 AND ((np >= 1 AND mid >= 0.4003 AND mid - pre >= 0.2003) OR (nq >= 1 AND mid >= 0.4003 AND mid - post >= 0.2003))),
l AS (SELECT *, max(e) OVER (PARTITION BY sample, chrom ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM g), f AS (SELECT *, SUM(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY e ROWS UNBOUNDED PRECEDING) AS isl FROM l)
SELECT sample, chrom, min(s) AS start_pos, max(e) AS end_pos FROM f GROUP BY sample, chrom, isl""")
def ndr(v):
    return L.depleted_regions(_sites(v), 60, 20, 4, 1, 2, 0.4003, 0.2003, keys=KEYS)


def _sites(v):
    return v.cytosine.select("sample", "chrom", "chrom_pos", F.col("c_reads").alias("c"), F.col("t_reads").alias("t"))


TESTED = """WITH s AS (SELECT sample, chrom, chrom_pos, c_reads / CAST(c_reads + t_reads AS DOUBLE) AS m FROM v_cytosine WHERE c_reads + t_reads >= 1),
w AS (SELECT sample, chrom, chrom_pos AS p, list(m) OVER (PARTITION BY sample, chrom ORDER BY chrom_pos RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS mid,
  list(m) OVER (PARTITION BY sample, chrom ORDER BY chrom_pos RANGE BETWEEN 89 PRECEDING AND 60 PRECEDING) AS pre, list(m) OVER (PARTITION BY sample, chrom ORDER BY chrom_pos RANGE BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS post FROM s),
x AS (SELECT sample, chrom, p, mid, unnest([pre, post]) AS adj FROM w WHERE len(mid) >= 5), k AS (SELECT *, len(mid) AS a, len(adj) AS b, list_concat(mid, adj) AS al FROM x WHERE len(adj) >= 3), {test},
g AS (SELECT DISTINCT sample, chrom, p - 59 AS s, p AS e FROM t WHERE ok),
l AS (SELECT *, max(e) OVER (PARTITION BY sample, chrom ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM g), f AS (SELECT *, SUM(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY e ROWS UNBOUNDED PRECEDING) AS isl FROM l)
SELECT sample, chrom, min(s) AS start_pos, max(e) AS end_pos FROM f GROUP BY sample, chrom, isl"""
# p < 0.1 is z > 1.2815515655446004
RANK = """r AS (SELECT *, list_sum(list_transform(mid, lambda v: len(list_filter(adj, lambda y: y < v)) + 0.5 * len(list_filter(adj, lambda y: y = v)))) AS u,
  list_sum(list_transform(al, lambda v: pow(len(list_filter(al, lambda y: y = v)), 2) - 1)) AS ties FROM k), n AS (SELECT *, a * b / 12.0::DOUBLE * (a + b + 1 - ties / ((a + b) * (a + b - 1))) AS var FROM r),
t AS (SELECT *, var > 1e-9 AND (u - a * b / 2.0 - 0.5) / sqrt(greatest(var, 1e-9)) > 1.2815515655446004 AS ok FROM n)"""
KS = """t AS (SELECT *, exp(-2.0 * pow(greatest(list_max(list_transform(al, lambda v: len(list_filter(adj, lambda y: y <= v)) / b::DOUBLE - len(list_filter(mid, lambda y: y <= v)) / a::DOUBLE)), 0), 2) * a * b / (a + b)) < 0.1 AS ok FROM k)"""


@question("w_ndr_rank_test", "v_cytosine", TESTED.format(test=RANK))
def ndr_rank(v):
    return L.depleted_regions(_sites(v), 60, 30, 5, 3, 1, test="rank", alpha=0.1, keys=KEYS)


@question("w_ndr_ks_test", "v_cytosine", TESTED.format(test=KS))
def ndr_ks(v):
    return L.depleted_regions(_sites(v), 60, 30, 5, 3, 1, test="ks", alpha=0.1, keys=KEYS)


# one step per read, in order; the state is the end of every lane
LANES = """WITH RECURSIVE d AS MATERIALIZED (SELECT chrom, read_id, start_pos, CAST(start_pos + mapq + 5 AS INT) AS end_pos, CAST({tier} AS INT) AS tier FROM v_read),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom, tier ORDER BY start_pos, end_pos, read_id) AS rn FROM d),
r AS (SELECT chrom, tier, rn, 1 AS lane, [end_pos] AS ends FROM o WHERE rn = 1
  UNION ALL SELECT chrom, tier, rn, lane, CASE WHEN lane > len(ends) THEN list_append(ends, end_pos) ELSE list_concat(ends[: lane - 1], [end_pos], ends[lane + 1 :]) END AS ends FROM (
    SELECT o.chrom, o.tier, o.rn, o.end_pos, r.ends, coalesce(nullif(list_position(list_transform(r.ends, lambda e: e < o.start_pos), true), 0), len(r.ends) + 1) AS lane
    FROM r JOIN o ON o.chrom = r.chrom AND o.tier = r.tier AND o.rn = r.rn + 1)),
w AS (SELECT o.*, CAST(r.lane - 1 AS INT) AS lane FROM o JOIN r ON r.chrom = o.chrom AND r.tier = o.tier AND r.rn = o.rn)"""


def _spans(v):
    return v.read.select("chrom", "read_id", "start_pos", (F.col("start_pos") + F.col("mapq") + 5).cast("int").alias("end_pos"), (F.col("mapq") / 40.0).alias("meth"))


@question("w_read_lanes", "v_read", LANES.format(tier=0) + " SELECT chrom, read_id, start_pos, end_pos, lane FROM w")
def read_lanes(v):
    return L.read_lanes(_spans(v))


@question("w_read_tiers", "v_read", LANES.format(tier="CASE WHEN mapq / 40.0::DOUBLE <= 0.3 THEN 0 WHEN mapq / 40.0::DOUBLE <= 0.7 THEN 1 ELSE 2 END") + """,
n AS (SELECT chrom, tier, max(lane) + 1 AS n FROM w GROUP BY 1, 2), b AS (SELECT chrom, tier, coalesce(SUM(n) OVER (PARTITION BY chrom ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n)
SELECT w.chrom, read_id, start_pos, end_pos, w.tier, lane, CAST(lane + below AS INT) AS level FROM w JOIN b ON b.chrom = w.chrom AND b.tier = w.tier""")
def read_tiers(v):
    return L.read_tiers(_spans(v), [float("-inf"), 0.3, 0.7, float("inf")])


@question("a_motif_density", "v_cytosine v_feature", f"""
WITH g AS (SELECT f.feat_id, f.chrom, f.start_pos, f.end_pos, COUNT(c.chrom_pos) AS n FROM v_feature f LEFT JOIN v_cytosine c ON c.chrom = f.chrom AND c.chrom_pos BETWEEN f.start_pos AND f.end_pos GROUP BY 1, 2, 3, 4)
SELECT feat_id, n, ROUND(100.0 * n / (end_pos - start_pos + 1), 6) AS density FROM g""")
def motif_density(v):
    d = L.motif_density(v.cytosine, v.feature.select("feat_id", "chrom", "start_pos", "end_pos"))
    return rounded(d, "density").select("feat_id", F.col("n").cast("bigint").alias("n"), "density")


@question("w_delta_align", BOTH, f"""
WITH d AS (SELECT a.chrom, a.chrom_pos, a.strand, a.sample AS sample_1, b.sample AS sample_2, abs(a.{FM.replace('(c_reads', '(a.c_reads').replace('+ t_reads', '+ a.t_reads')} - b.{FM.replace('(c_reads', '(b.c_reads').replace('+ t_reads', '+ b.t_reads')}) AS m
  FROM v_cytosine a JOIN v_cytosine b ON b.chrom = a.chrom AND b.chrom_pos = a.chrom_pos AND b.strand = a.strand AND a.sample < b.sample),
f AS (SELECT *, {MID} AS mid FROM v_feature), p AS (SELECT sample_1, sample_2, CASE WHEN f.strand = '-' THEN mid - chrom_pos ELSE chrom_pos - mid END AS off, d.strand = CASE WHEN f.strand = '-' THEN '-' ELSE '+' END AS same, m
  FROM d JOIN f ON f.chrom = d.chrom AND chrom_pos BETWEEN mid - 40 AND mid + 40 WHERE m IS NOT NULL)
SELECT sample_1, sample_2, CAST(off AS INT) AS "offset", ROUND(SUM(m) FILTER (WHERE same), 4) AS own_sum, COUNT(m) FILTER (WHERE same) AS own_n, ROUND(SUM(m) FILTER (WHERE NOT same), 4) AS other_sum, COUNT(m) FILTER (WHERE NOT same) AS other_n FROM p GROUP BY 1, 2, 3""")
def delta_align(v):
    out = L.aligned_average(A.sample_deltas(v.cytosine), v.feature, 40, "chrom_pos", F.col("delta"), ["sample_1", "sample_2"])
    return rounded(out, "own_sum", "other_sum", digits=4).withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("own_n", "other_n")})
