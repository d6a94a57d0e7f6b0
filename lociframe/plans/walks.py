"""Positional walks over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import methylation as M
from lociframe.operators import joins as J
from lociframe.operators import walks as W
from lociframe.plans.aggregates import rounded
from lociframe.plans.joins import typed
from lociframe.plans.registry import near, question

C, FEAT = "v_cytosine", "v_feature"
FM = "c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE)"


@question("w_spatial_weight", C, """
WITH l AS (SELECT *, lag(chrom_pos) OVER w AS p1, lag(chrom_pos, 2) OVER w AS p2, lag(strand) OVER w AS s1 FROM v_cytosine WINDOW w AS (PARTITION BY sample, chrom ORDER BY chrom_pos))
SELECT sample, chrom, chrom_pos, strand, CASE WHEN chrom_pos - p1 = 1 AND strand = '-' AND s1 = '+' THEN coalesce(p1 - p2, 0) ELSE chrom_pos - p1 END AS weight FROM l""")
def spatial_weight(v):
    return W.spatial_weight(v.cytosine)


@question("w_midpoint_weight", C, """
WITH d AS (SELECT DISTINCT chrom, chrom_pos FROM v_cytosine), n AS (SELECT *, lag(chrom_pos) OVER w AS a, lead(chrom_pos) OVER w AS b FROM d WINDOW w AS (PARTITION BY chrom ORDER BY chrom_pos))
SELECT chrom, chrom_pos, CAST(coalesce((chrom_pos + b) // 2, chrom_pos) - coalesce((a + chrom_pos) // 2, chrom_pos) + 1 AS BIGINT) AS weight FROM n""")
def midpoint_weight(v):
    return W.midpoint_weight(v.cytosine)


def windows_sql(span, k, src="v_cytosine", val="m", extra=""):
    """Windows by row number, as a row-by-row reading of the eviction rule."""
    return f"""x AS (SELECT *, {FM} AS m FROM {src}),
r AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom ORDER BY chrom_pos) AS i FROM x),
s AS (SELECT *, coalesce(max(i) OVER (PARTITION BY sample, chrom ORDER BY chrom_pos RANGE BETWEEN UNBOUNDED PRECEDING AND {span} PRECEDING), 1) AS i0 FROM r),
win AS (SELECT e.sample, e.chrom, min(w.chrom_pos) AS start_pos, e.chrom_pos AS end_pos, COUNT(*) AS n, avg(w.m) AS mean, min(w.m) AS lo, max(w.m) AS hi{extra}
  FROM s e JOIN r w ON w.sample = e.sample AND w.chrom = e.chrom AND w.i BETWEEN e.i0 AND e.i GROUP BY 1, 2, e.chrom_pos HAVING COUNT(*) >= {k} AND e.chrom_pos - min(w.chrom_pos) >= {span})"""


DOMAIN_TAIL = """g AS (SELECT *, CASE WHEN start_pos > coalesce(max(end_pos) OVER (PARTITION BY sample, chrom ORDER BY end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM good),
d AS (SELECT *, SUM(fresh) OVER (PARTITION BY sample, chrom ORDER BY end_pos ROWS UNBOUNDED PRECEDING) AS isl FROM g)"""


@question("w_scan_fixed", C, f"WITH {windows_sql(60, 4)} SELECT sample, chrom, start_pos, end_pos, n, ROUND(mean, 6) AS mean FROM win")
def scan_fixed(v):
    return rounded(W.methylation_windows(v.cytosine, 60, 4), "mean")


@question("w_scan_weighted", C, """
WITH l AS (SELECT *, lag(chrom_pos) OVER w AS p1, lag(chrom_pos, 2) OVER w AS p2, lag(strand) OVER w AS s1 FROM v_cytosine WINDOW w AS (PARTITION BY sample, chrom ORDER BY chrom_pos)),
y AS (SELECT *, CASE WHEN chrom_pos - p1 = 1 AND strand = '-' AND s1 = '+' THEN coalesce(p1 - p2, 0) ELSE chrom_pos - p1 END AS wt FROM l),
""" + windows_sql(60, 4, "y", extra=", SUM(w.m * w.wt) FILTER (WHERE w.wt > 0) AS sx, SUM(w.wt) FILTER (WHERE w.wt > 0 AND w.m IS NOT NULL) AS sw") + """
SELECT sample, chrom, start_pos, end_pos, n, ROUND(sx / nullif(sw, 0), 6) AS mean FROM win""")
def scan_weighted(v):
    return rounded(W.methylation_windows(v.cytosine, 60, 4, weighted=True), "mean")


@question("w_scan_variable", C, f"""
WITH r AS (SELECT sample, chrom, chrom_pos, coalesce({FM}, 0) AS m, row_number() OVER (PARTITION BY sample, chrom ORDER BY chrom_pos) AS i FROM v_cytosine),
b AS (SELECT e.sample, e.chrom, e.chrom_pos AS end_pos, e.i, max(w.i) AS j FROM r e JOIN r w ON w.sample = e.sample AND w.chrom = e.chrom AND w.i <= e.i - 3 AND w.chrom_pos <= e.chrom_pos - 40 AND e.chrom_pos - w.chrom_pos < 150 GROUP BY 1, 2, 3, 4)
SELECT b.sample, b.chrom, min(w.chrom_pos) FILTER (WHERE w.i > b.j) AS start_pos, b.end_pos, CAST(max(b.i - b.j) AS BIGINT) AS n, ROUND(SUM(w.m), 6) AS total
FROM b JOIN r w ON w.sample = b.sample AND w.chrom = b.chrom AND w.i BETWEEN b.j AND b.i GROUP BY b.sample, b.chrom, b.end_pos""")
def scan_variable(v):
    return rounded(W.scan_windows_variable(v.cytosine, 40, 150, 3, {"total": M.frac_meth()}), "total")


@question("w_domains", C, f"""
WITH {windows_sql(60, 4)}, good AS (SELECT * FROM win WHERE mean BETWEEN 0 AND 0.5531), {DOMAIN_TAIL}
SELECT sample, chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, ROUND(arg_min(mean, end_pos), 6) AS score, COUNT(*) AS n_windows
FROM d GROUP BY sample, chrom, isl HAVING max(end_pos) - min(start_pos) + 1 >= 70""")
def domains(v):
    win = W.methylation_windows(v.cytosine, 60, 4)
    return rounded(W.find_domains(win, F.col("mean").between(0, 0.5531), F.col("mean"), min_len=70), "score")


PAIRED = f"""ab AS (SELECT 'AB' AS sample, a.chrom, a.chrom_pos, a.c_reads, a.t_reads, a.c_reads / CAST(a.c_reads + a.t_reads AS DOUBLE) AS ma, b.c_reads / CAST(b.c_reads + b.t_reads AS DOUBLE) AS mb
  FROM v_cytosine a JOIN v_cytosine b ON a.chrom = b.chrom AND a.chrom_pos = b.chrom_pos AND a.sample = 'A' AND b.sample = 'B' WHERE a.c_reads + a.t_reads > 0 AND b.c_reads + b.t_reads > 0)"""


def paired(v):
    d = v.cytosine.withColumn("m", M.frac_meth()).filter(F.col("m").isNotNull())
    return J.align_samples(d, ["A", "B"], ["m"])


@question("w_diff_domains", C, f"""
WITH {PAIRED}, {windows_sql(100, 3, "ab", extra=", avg(w.ma) AS ma, avg(w.mb) AS mb")}, good AS (SELECT * FROM win WHERE mb - ma >= 0.0501 AND ma <= 0.6003 AND mb >= 0.4003), {DOMAIN_TAIL}
SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, ROUND(arg_min(ma, end_pos), 6) AS score, COUNT(*) AS n_windows FROM d GROUP BY sample, chrom, isl""")
def diff_domains(v):
    win = W.scan_windows(paired(v), 100, 3, {"sa": F.col("m_A"), "sb": F.col("m_B")}, ["chrom"])
    a, b = F.col("sa") / F.col("n"), F.col("sb") / F.col("n")
    return rounded(W.find_domains(win, (b - a >= 0.0501) & (a <= 0.6003) & (b >= 0.4003), a, ["chrom"]), "score")


@question("w_window_means", C, f"""
WITH {PAIRED}, {windows_sql(100, 3, "ab", extra=", avg(w.ma) AS ma, avg(w.mb) AS mb")} SELECT chrom, start_pos, end_pos, n, ROUND(ma, 6) AS mean_a, ROUND(mb, 6) AS mean_b FROM win""")
def window_means(v):
    win = W.scan_windows(paired(v), 100, 3, {"sa": F.col("m_A"), "sb": F.col("m_B")}, ["chrom"])
    return win.select("chrom", "start_pos", "end_pos", "n", near(F.col("sa") / F.col("n"), 6).alias("mean_a"), near(F.col("sb") / F.col("n"), 6).alias("mean_b"))


@question("w_multisample_range", C, f"""
WITH {PAIRED}, {windows_sql(40, 2, "ab", extra=", min(w.ma) AS alo, max(w.ma) AS ahi, min(w.mb) AS blo, max(w.mb) AS bhi")}
SELECT chrom, start_pos, end_pos, n FROM win WHERE ((alo >= 0.3 AND ahi <= 0.7) OR (blo >= 0.3 AND bhi <= 0.7)) AND (ahi < 0.3 OR alo > 0.7 OR bhi < 0.3 OR blo > 0.7)""")
def multisample_range(v):
    win = W.scan_windows(paired(v), 40, 2, {}, ["chrom"], extremes={"a": F.col("m_A"), "b": F.col("m_B")})
    inside = lambda s: (F.col(f"{s}_min") >= 0.3) & (F.col(f"{s}_max") <= 0.7)
    outside = lambda s: (F.col(f"{s}_max") < 0.3) | (F.col(f"{s}_min") > 0.7)
    return win.filter((inside("a") | inside("b")) & (outside("a") | outside("b"))).select("chrom", "start_pos", "end_pos", "n")


@question("w_phasing", C, f"""
WITH m AS (SELECT *, {FM} AS m FROM v_cytosine WHERE c_reads + t_reads > 0),
p AS (SELECT b.sample, b.chrom, b.chrom_pos, abs(a.m - b.m) AS d, b.chrom_pos - a.chrom_pos AS k FROM m a JOIN m b ON a.sample = b.sample AND a.chrom = b.chrom AND b.chrom_pos - a.chrom_pos BETWEEN 17 AND 53),
c AS (SELECT *, (k BETWEEN 27 AND 33 OR k BETWEEN 47 AND 53) AS o FROM p), f AS (SELECT *, NOT o AND (k BETWEEN 17 AND 23 OR k BETWEEN 37 AND 43) AS i FROM c)
SELECT sample, chrom, chrom_pos, ROUND(avg(d) FILTER (WHERE o), 6) AS off_phase, ROUND(avg(d) FILTER (WHERE i), 6) AS in_phase FROM f WHERE o OR i GROUP BY 1, 2, 3""")
def phasing(v):
    return rounded(W.phasing(v.cytosine, 20, 3), "off_phase", "in_phase")


@question("w_window_track", C, f"""
WITH {windows_sql(60, 4)}, k AS (SELECT sample, chrom, end_pos, (start_pos + end_pos + 1) // 2 AS mid, CAST(FLOOR(round(100.0 * mean, 9) + 0.5) AS BIGINT) AS value FROM win),
n AS (SELECT *, (lag(mid) OVER w + mid) // 2 + 1 AS span_start, (lead(mid) OVER w + mid) // 2 AS span_end FROM k WINDOW w AS (PARTITION BY sample, chrom ORDER BY end_pos))
SELECT sample, chrom, CAST(span_start AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end, value FROM n WHERE span_start IS NOT NULL AND span_end IS NOT NULL""")
def window_track(v):
    return W.window_track(W.methylation_windows(v.cytosine, 60, 4))


@question("w_smooth", C, """
WITH t AS (SELECT sample, chrom, chrom_pos AS pos, CAST(c_reads AS DOUBLE) AS value FROM v_cytosine), z AS (SELECT sample, chrom, min(pos) AS lo, max(pos) AS hi FROM t GROUP BY 1, 2),
e AS (SELECT t.sample, t.chrom, lo, unnest(generate_series(pos, least(pos + 19, hi))) AS we, value FROM t JOIN z ON z.sample = t.sample AND z.chrom = t.chrom WHERE pos >= lo + 19),
g AS (SELECT sample, chrom, we - 19 + 9 AS centre, SUM(value) / least(20, we - (lo + 19) + 1) AS value FROM e GROUP BY sample, chrom, we, lo)
SELECT sample, chrom, CAST(centre // 5 AS BIGINT) AS pos, ROUND(value, 6) AS value FROM g WHERE centre % 5 = 0 AND value > 0.2""")
def smooth(v):
    t = v.cytosine.select("sample", "chrom", F.col("chrom_pos").alias("pos"), F.col("c_reads").cast("double").alias("value"))
    return rounded(W.smooth(t, 20, 0.2, step=5, keys=("sample", "chrom")), "value")


SIZES = "z AS (SELECT chrom, CAST(max(chrom_pos) AS BIGINT) AS length FROM v_cytosine GROUP BY 1)"


def sizes(v):
    return v.cytosine.groupBy("chrom").agg(F.max("chrom_pos").alias("length"))


@question("w_cpg_density", C, f"""
WITH {SIZES}, c AS (SELECT sample, chrom, length, unnest(generate_series(1, length, 40)) AS centre FROM z JOIN (SELECT DISTINCT sample, chrom FROM v_cytosine) USING (chrom)), w AS (SELECT *, greatest(centre - 50, 1) AS s, least(centre + 49, length) AS e FROM c)
SELECT w.sample, w.chrom, CAST(w.centre AS BIGINT) AS centre, COUNT(k.chrom_pos) AS n, CAST(FLOOR(100.0 * (COUNT(k.chrom_pos) / 2.0) / max(e - s + 1) + 0.5) AS BIGINT) AS density, ROUND(avg({FM}), 6) AS mean_meth
FROM w LEFT JOIN v_cytosine k ON k.sample = w.sample AND k.chrom = w.chrom AND k.chrom_pos BETWEEN s AND e GROUP BY 1, 2, 3""")
def cpg_density(v):
    lengths = v.cytosine.select("sample", "chrom").distinct().join(sizes(v), "chrom")
    return rounded(W.stepped_density(v.cytosine, lengths, 100, 40, keys=("sample", "chrom")), "mean_meth")


@question("w_stretch_window", C, f"""
WITH {PAIRED}, {SIZES}, c AS (SELECT chrom, unnest(generate_series(1, length, 100)) AS centre FROM z), w AS (SELECT chrom, centre, width, centre - width // 2 AS s, centre + width // 2 AS e FROM c, (VALUES (60), (110), (160), (210), (260)) AS t(width)),
g AS (SELECT w.chrom, w.centre, w.width, COUNT(*) AS n, avg(ma) AS a, avg(mb) AS b FROM w JOIN ab ON ab.chrom = w.chrom AND ab.chrom_pos BETWEEN s AND e GROUP BY 1, 2, 3 HAVING COUNT(*) >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom, centre ORDER BY width) AS rn FROM g)
SELECT chrom, CAST(centre AS BIGINT) AS centre, width, n, ROUND(a, 6) AS "mean_A", ROUND(b, 6) AS "mean_B", ROUND(b - a, 6) AS delta FROM r WHERE rn = 1""")
def stretch_window(v):
    return rounded(W.stretch_windows(paired(v), sizes(v), 60, 50, 260, 100, 5, ("A", "B")), "mean_A", "mean_B", "delta")


@question("w_boundary_density", f"{C} {FEAT}", """
WITH c AS (SELECT feat_id AS id, chrom, start_pos AS centre FROM v_feature WHERE feat_type = '1-URGENT'), w AS (SELECT c.*, k, centre + k * 15 + CASE WHEN k >= 0 THEN 1 ELSE 0 END AS s FROM c, (SELECT unnest(generate_series(-4, 3)) AS k) t),
n AS (SELECT w.id, w.chrom, w.centre, w.k, COUNT(p.chrom_pos) AS n FROM w LEFT JOIN (SELECT DISTINCT chrom, chrom_pos FROM v_cytosine) p ON p.chrom = w.chrom AND p.chrom_pos BETWEEN w.s AND w.s + 14 GROUP BY 1, 2, 3, 4),
g AS (SELECT id, chrom, centre, SUM(CASE WHEN k < 0 THEN -n ELSE n END) AS balance, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS up, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k DESC) AS down FROM n GROUP BY 1, 2, 3)
SELECT id, chrom, centre, CAST(balance AS BIGINT) AS balance, CASE WHEN balance < 0 THEN down ELSE up END AS counts FROM g""")
def boundary_density(v):
    c = typed(v, "1-URGENT").select(F.col("feat_id").alias("id"), "chrom", F.col("start_pos").alias("centre"))
    out = W.boundary_density(c, v.cytosine.select("chrom", "chrom_pos").distinct(), 15, 4)
    return out.withColumn("counts", F.array_join(F.transform("counts", lambda x: x.cast("string")), ","))


@question("w_peak_runs", C, """
WITH t AS (SELECT sample, chrom, chrom_pos, c_reads >= 4 AS ok FROM v_cytosine), b AS (SELECT *, SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY sample, chrom ORDER BY chrom_pos) AS g FROM t)
SELECT sample, chrom, CASE WHEN min(chrom_pos) - 10 = 0 THEN 1 ELSE min(chrom_pos) - 10 END AS start_pos, max(chrom_pos) + 10 AS end_pos, COUNT(*) AS n FROM b WHERE ok GROUP BY sample, chrom, g HAVING COUNT(*) >= 3""")
def peak_runs(v):
    t = v.cytosine.select("sample", "chrom", F.col("chrom_pos").alias("pos"), "c_reads")
    return W.peak_runs(t, F.col("c_reads") >= 4, 10, 3, keys=("sample", "chrom"))


@question("w_fill_gaps", FEAT, """
WITH l AS (SELECT *, lag(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos) AS pe FROM v_feature WHERE feat_type = '2-HIGH')
SELECT feat_id, start_pos, end_pos, CASE WHEN start_pos - pe BETWEEN 0 AND 40 THEN pe + 1 ELSE start_pos END AS filled_start FROM l""")
def fill_gaps(v):
    return W.fill_gaps(typed(v, "2-HIGH"), 40).select("feat_id", "start_pos", "end_pos", "filled_start")


@question("w_complement", FEAT, """
WITH l AS (SELECT chrom, start_pos - 2 AS s, end_pos + 2 AS e FROM v_feature WHERE feat_type = '2-HIGH'), g AS (SELECT *, lag(e) OVER (PARTITION BY chrom ORDER BY s, e) AS pe FROM l)
SELECT chrom, pe + 1 AS gap_start, s - 1 AS gap_end FROM g WHERE pe < s AND pe + 1 <= s - 1""")
def complement(v):
    return W.complement(typed(v, "2-HIGH"), 2)


MERGED = """l AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v_feature WHERE feat_type = '2-HIGH'),
f AS (SELECT *, SUM(CASE WHEN pe IS NULL OR start_pos > pe + {k} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS isl FROM l),
m AS (SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, COUNT(*) AS n, CAST(SUM(score) AS DOUBLE) AS score FROM f GROUP BY chrom, isl)"""


@question("w_complement_merged", FEAT, f"""
WITH {MERGED.format(k=0)}, g AS (SELECT *, lag(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS pe FROM m)
SELECT chrom, pe + 1 AS gap_start, start_pos - 1 AS gap_end FROM g WHERE pe + 1 <= start_pos - 1""")
def complement_merged(v):
    return W.complement(typed(v, "2-HIGH"), 0, merged=True)


@question("w_clusters", FEAT, f"WITH {MERGED.format(k=5)} SELECT chrom, start_pos, end_pos, n, score FROM m WHERE n >= 2")
def clusters(v):
    return W.cluster(typed(v, "2-HIGH"), 5, min_members=2)


@question("w_clusters_scored", FEAT, """
WITH t AS (SELECT * FROM v_feature WHERE feat_type = '5-LOW'), b AS (SELECT *, SUM(CASE WHEN score < 300 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos) AS brk FROM t),
o AS (SELECT * FROM b WHERE score >= 300), l AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom, brk ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o),
f AS (SELECT *, SUM(CASE WHEN pe IS NULL OR start_pos - pe > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, brk ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS isl FROM l)
SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, COUNT(*) AS n, CAST(SUM(score) AS DOUBLE) AS score FROM f GROUP BY chrom, brk, isl""")
def clusters_scored(v):
    return W.cluster(typed(v, "5-LOW"), 5, min_score=300)


# one step per span, in order
@question("w_clusters_capped", "v_feature", """WITH RECURSIVE u AS MATERIALIZED (SELECT chrom, start_pos, end_pos, COUNT(*) AS n, SUM(score) AS score FROM v_feature GROUP BY ALL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start_pos, end_pos) AS rn FROM u),
r AS (SELECT chrom, rn, start_pos AS b, end_pos AS reach, 1 AS cl FROM o WHERE rn = 1
  UNION ALL SELECT o.chrom, o.rn, CASE WHEN o.end_pos - b > 120 OR o.start_pos - reach > 5 THEN o.start_pos ELSE b END, CASE WHEN o.end_pos - b > 120 OR o.start_pos - reach > 5 THEN o.end_pos ELSE greatest(reach, o.end_pos) END,
    cl + CASE WHEN o.end_pos - b > 120 OR o.start_pos - reach > 5 THEN 1 ELSE 0 END FROM r JOIN o ON o.chrom = r.chrom AND o.rn = r.rn + 1)
SELECT o.chrom, min(o.start_pos) AS start_pos, max(o.end_pos) AS end_pos, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(score) AS DOUBLE) AS score FROM o JOIN r ON r.chrom = o.chrom AND r.rn = o.rn GROUP BY o.chrom, cl""")
def clusters_capped(v):
    return W.cluster(v.feature, 5, max_size=120)


@question("w_paired_delta", C, f"WITH {PAIRED} SELECT chrom, chrom_pos, ROUND(mb - ma, 6) AS delta FROM ab")
def paired_delta(v):
    return paired(v).select("chrom", "chrom_pos", near(F.col("m_B") - F.col("m_A"), 6).alias("delta"))


@question("w_multi_meth", C, f"WITH {PAIRED} SELECT chrom, chrom_pos, ROUND(ma, 6) AS \"m_A\", ROUND(mb, 6) AS \"m_B\" FROM ab")
def multi_meth(v):
    return rounded(paired(v), "m_A", "m_B")


@question("w_context_window", "v_base", """
WITH r AS (SELECT DISTINCT chrom, pos, ref_base FROM v_base)
SELECT chrom, pos, ref_base, max(ref_base) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS ref_base_m2,
  max(ref_base) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ref_base_m1, max(ref_base) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS ref_base_p1 FROM r""")
def context_window(v):
    from lociframe.operators.lookups import base_neighbours

    return base_neighbours(v.base.select("chrom", "pos", "ref_base").distinct(), 2, 1)
