"""Summaries over positions, features and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import methylation as M
from lociframe.operators import aggregates as A
from lociframe.operators import joins as J
from lociframe.plans.joins import CALLS_SQL, calls, typed
from lociframe.plans.registry import near, question

C, FEAT, BOTH = "v_cytosine", "v_feature", "v_cytosine v_feature"
FM = "c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE)"
NOT_MUT = "NOT (a_reads_opp >= 2 AND coalesce(a_reads_opp / CAST(nullif(a_reads_opp + total_reads_opp, 0) AS DOUBLE), -1) >= 0.2)"
PER_TYPE = "SELECT DISTINCT c.*, f.feat_type FROM v_cytosine c JOIN v_feature f ON f.chrom = c.chrom AND c.chrom_pos BETWEEN f.start_pos AND f.end_pos"
TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
BIG = lambda e: f"CAST(SUM({e}) AS BIGINT)"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: near(F.col(c), digits) for c in cols})


@question("a_meth_by_feature", BOTH, f"""
WITH p AS ({PER_TYPE}), m AS (SELECT *, {FM} AS m FROM p WHERE {NOT_MUT})
SELECT sample, feat_type, COUNT(*) AS n_cytosines, ROUND(avg(m), 6) AS mean_meth, ROUND(avg(m) FILTER (WHERE strand = '+'), 6) AS mean_meth_fw,
  ROUND(avg(m) FILTER (WHERE strand = '-'), 6) AS mean_meth_rev FROM m GROUP BY 1, 2""")
def meth_by_feature(v):
    return rounded(A.methylation_by_feature(v.cytosine, v.feature), "mean_meth", "mean_meth_fw", "mean_meth_rev")


@question("a_summary", C, f"""
WITH m AS (SELECT *, {FM} AS m, chrom_pos % 7 - 1 AS w FROM v_cytosine)
SELECT sample, chrom, COUNT(m) AS n, ROUND(SUM(m), 4) AS sum, ROUND(avg(m), 6) AS mean, ROUND(stddev_pop(m), 6) AS stdev, ROUND(min(m), 6) AS min, ROUND(max(m), 6) AS max,
  ROUND(SUM(m * w) FILTER (WHERE w > 0) / SUM(w) FILTER (WHERE w > 0 AND m IS NOT NULL), 6) AS weighted_mean FROM m GROUP BY 1, 2""")
def summary(v):
    out = A.summarize(v.cytosine, ["sample", "chrom"], M.frac_meth(), F.col("chrom_pos") % 7 - 1)
    return rounded(rounded(out, "mean", "stdev", "min", "max", "weighted_mean"), "sum", digits=4)


@question("a_qc_by_feature", BOTH, f"""
WITH p AS ({PER_TYPE}), z AS (SELECT feat_type, SUM(end_pos - start_pos + 1) AS bases FROM v_feature GROUP BY 1)
SELECT sample, p.feat_type, COUNT(*) AS n, ROUND(avg(c_reads + c_reads_nonconv + t_reads + ag_reads), 6) AS coverage,
  ROUND(avg(CASE WHEN {NOT_MUT} THEN 0.0 ELSE 100.0 END), 6) AS deamination_pct,
  ROUND(avg(100.0 * c_reads_nonconv / nullif(c_reads + c_reads_nonconv + t_reads, 0)) FILTER (WHERE {NOT_MUT} AND total_reads_opp >= 5), 6) AS nonconversion_pct,
  ROUND(COUNT(*) / CAST(max(bases) AS DOUBLE), 6) AS density FROM p JOIN z ON z.feat_type = p.feat_type GROUP BY 1, 2""")
def qc_by_feature(v):
    return rounded(A.qc_by_feature(v.cytosine, v.feature), "coverage", "deamination_pct", "nonconversion_pct", "density")


@question("a_feature_shores", BOTH, f"""
WITH n AS (SELECT *, lag(start_pos) OVER w AS ps, lag(end_pos) OVER w AS pe, lead(start_pos) OVER w AS ns, lead(end_pos) OVER w AS ne
  FROM v_feature WHERE feat_type = '1-URGENT' WINDOW w AS (PARTITION BY chrom ORDER BY start_pos, end_pos)),
s AS (SELECT *, CASE WHEN strand = '-' THEN end_pos + 5 ELSE start_pos - 60 END AS shore_start, CASE WHEN strand = '-' THEN end_pos + 60 ELSE start_pos - 5 END AS shore_end FROM n),
k AS (SELECT feat_id, chrom, shore_start, shore_end FROM s WHERE NOT coalesce(shore_start <= pe AND ps <= shore_end, false) AND NOT coalesce(shore_start <= ne AND ns <= shore_end, false)),
g AS (SELECT k.*, t.sample FROM k, (VALUES ('A'), ('B')) AS t(sample))
SELECT g.feat_id, g.sample, g.shore_start, g.shore_end, COUNT(c.chrom_pos) AS n, ROUND(avg({FM}), 6) AS mean_meth, ROUND(avg(c_reads + t_reads), 6) AS mean_reads
FROM g LEFT JOIN v_cytosine c ON c.chrom = g.chrom AND c.sample = g.sample AND c.chrom_pos BETWEEN g.shore_start AND g.shore_end GROUP BY 1, 2, 3, 4""")
def feature_shores(v):
    s = A.shores(typed(v, "1-URGENT"), 5, 60).select("feat_id", "chrom", "shore_start", "shore_end")
    out = A.feature_statistics(v.dealt_cytosine(), s, ["A", "B"], "shore_start", "shore_end").drop("chrom")
    return rounded(out, "mean_meth", "mean_reads")


@question("a_feature_stats", BOTH, f"""
WITH g AS (SELECT f.feat_id, f.chrom, f.start_pos, f.end_pos, t.sample FROM v_feature f, (VALUES ('A'), ('B')) AS t(sample))
SELECT g.feat_id, g.sample, COUNT(c.chrom_pos) AS n, ROUND(avg({FM}), 6) AS mean_meth, ROUND(avg(c_reads + t_reads), 6) AS mean_reads
FROM g LEFT JOIN v_cytosine c ON c.chrom = g.chrom AND c.sample = g.sample AND c.chrom_pos BETWEEN g.start_pos AND g.end_pos GROUP BY 1, 2""")
def feature_stats(v):
    f = v.feature.select("feat_id", "chrom", "start_pos", "end_pos")
    out = A.feature_statistics(v.dealt_cytosine(), f, ["A", "B"], "start_pos", "end_pos")
    return rounded(out, "mean_meth", "mean_reads").select("feat_id", "sample", "n", "mean_meth", "mean_reads")


@question("a_window_meth", BOTH, f"""
WITH z AS (SELECT f.feat_id, f.chrom, t.sample, s.size, CASE WHEN s.size = 0 THEN start_pos ELSE CAST(FLOOR(start_pos - s.size / 2.0 + 0.5) AS INT) END AS lo,
  CASE WHEN s.size = 0 THEN end_pos ELSE CAST(FLOOR(end_pos + s.size / 2.0 + 0.5) AS INT) END AS hi
  FROM v_feature f, (VALUES ('A'), ('B')) AS t(sample), (VALUES (0), (50), (125)) AS s(size) WHERE f.feat_type = '2-HIGH'),
m AS (SELECT z.feat_id, z.chrom, z.sample, z.size, avg({FM}) FILTER (WHERE z.size = 0 OR coalesce((c_reads + c_reads_nonconv) / CAST(nullif(c_reads + c_reads_nonconv + t_reads, 0) AS DOUBLE), 1) >= 0.3) AS mean
  FROM z LEFT JOIN v_cytosine c ON c.chrom = z.chrom AND c.sample = z.sample AND c.chrom_pos BETWEEN lo AND hi GROUP BY 1, 2, 3, 4)
SELECT feat_id, chrom, sample, ROUND(max(mean) FILTER (WHERE size = 0), 6) AS w0, ROUND(max(mean) FILTER (WHERE size = 50), 6) AS w50, ROUND(max(mean) FILTER (WHERE size = 125), 6) AS w125
FROM m GROUP BY 1, 2, 3""")
def window_meth(v):
    out = A.window_methylation(v.dealt_cytosine(), typed(v, "2-HIGH"), [0, 50, 125], ["A", "B"], min_meth_outside=0.3)
    return rounded(out, "w0", "w50", "w125")


@question("a_window_meth_five", BOTH, f"""
WITH z AS (SELECT f.feat_id, f.chrom, t.sample, CASE WHEN strand = '+' THEN start_pos - 80 WHEN strand = '-' THEN end_pos ELSE start_pos END AS lo,
  CASE WHEN strand = '+' THEN start_pos WHEN strand = '-' THEN end_pos + 80 ELSE end_pos END AS hi FROM v_feature f, (VALUES ('A'), ('B')) AS t(sample) WHERE f.feat_type = '5-LOW')
SELECT z.feat_id, z.chrom, z.sample, ROUND(avg({FM}), 6) AS w80 FROM z LEFT JOIN v_cytosine c ON c.chrom = z.chrom AND c.sample = z.sample AND c.chrom_pos BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def window_meth_five(v):
    return rounded(A.window_methylation(v.dealt_cytosine(), typed(v, "5-LOW"), [80], ["A", "B"], side="five"), "w80")


@question("a_meth_histogram", BOTH, f"""
WITH p AS ({PER_TYPE}), b AS (SELECT sample, feat_type, greatest(0, least(9, CAST(ceil(({FM} - 0.0) / 0.1) AS INT) - 1)) AS bin FROM p WHERE c_reads + t_reads > 0)
SELECT sample, feat_type, bin, COUNT(*) AS n, ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY sample, feat_type) AS DOUBLE), 6) AS share FROM b GROUP BY 1, 2, 3""")
def meth_histogram(v):
    rows = A.within_each_type(v.cytosine, v.feature)
    return rounded(A.histogram(rows, M.frac_meth(), 0.0, 1.0, 10, ["sample", "feat_type"], normalized=True), "share")


@question("a_coverage_hist", BOTH, f"""
WITH p AS ({PER_TYPE}), r AS (SELECT sample, c_reads + t_reads AS coverage, NULL AS t FROM v_cytosine UNION ALL SELECT sample, c_reads + t_reads, feat_type FROM p WHERE feat_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
SELECT sample, coverage, COUNT(*) FILTER (WHERE t IS NULL) AS all_positions, COUNT(*) FILTER (WHERE t = '1-URGENT') AS "1-URGENT", COUNT(*) FILTER (WHERE t = '2-HIGH') AS "2-HIGH",
  COUNT(*) FILTER (WHERE t = '3-MEDIUM') AS "3-MEDIUM" FROM r GROUP BY 1, 2""")
def coverage_hist(v):
    return A.coverage_histogram(v.cytosine, v.feature, TYPES)


@question("a_depth_counts", "v_base", """
SELECT CASE WHEN strand = '-' THEN -n ELSE n END AS depth, COUNT(*) AS n_positions FROM (SELECT chrom, pos, strand, COUNT(*) AS n FROM v_base GROUP BY 1, 2, 3) GROUP BY 1""")
def depth_counts(v):
    return A.depth_counts(v.tiled_bases())


@question("a_composite_cpg", C, f"""
SELECT chrom, chrom_pos, strand, COUNT(*) AS n_samples, {BIG('c_reads')} AS c_reads, {BIG('t_reads')} AS t_reads, {BIG('ag_reads')} AS ag_reads FROM v_cytosine GROUP BY 1, 2, 3""")
def composite_cpg(v):
    return A.composite(v.cytosine, ["c_reads", "t_reads", "ag_reads"])


STATS = """SELECT *, t_reads AS next_base_g, t_reads + ag_reads AS next_base_total, c_reads + c_reads_nonconv + t_reads + ag_reads AS total FROM v_cytosine"""


@question("a_cytosine_stats", C, f"""
WITH s AS ({STATS}), k AS (SELECT *, CASE WHEN coalesce(a_reads_opp / CAST(nullif(a_reads_opp + total_reads_opp, 0) AS DOUBLE) > 0.2, false)
   OR coalesce((c_reads + c_reads_nonconv + t_reads) / CAST(nullif(total, 0) AS DOUBLE) < 1 - 0.2, false) THEN 'noncyt'
  WHEN coalesce(next_base_g / CAST(nullif(next_base_total, 0) AS DOUBLE) >= 1 - 0.1, false) THEN 'CG'
  WHEN coalesce(next_base_g / CAST(nullif(next_base_total, 0) AS DOUBLE) < 0.1, false) THEN 'CH' ELSE 'uncertain' END AS category FROM s WHERE total > 0)
SELECT sample, category, COUNT(*) AS n, {BIG('total - c_reads_nonconv')} AS reads_ss, {BIG('total + total_reads_opp - c_reads_nonconv')} AS reads_ds,
  COUNT(*) FILTER (WHERE total >= 5) AS ge5_ss, COUNT(*) FILTER (WHERE total >= 10) AS ge10_ss, COUNT(*) FILTER (WHERE total + total_reads_opp >= 5) AS ge5_ds,
  COUNT(*) FILTER (WHERE total + total_reads_opp >= 10) AS ge10_ds, ROUND(avg({FM}), 6) AS mean_meth, {BIG('c_reads + t_reads')} AS ct_reads, {BIG('c_reads')} AS c_reads
FROM k GROUP BY 1, 2""")
def cytosine_stats(v):
    d = v.cytosine.withColumns({"next_base_g": F.col("t_reads"), "next_base_total": F.col("t_reads") + F.col("ag_reads")})
    return rounded(A.cytosine_stats(d), "mean_meth")


@question("a_conversion_by_coverage", C, "SELECT sample, c_reads + t_reads AS coverage, c_reads, COUNT(*) AS n FROM v_cytosine GROUP BY 1, 2, 3")
def conversion_by_coverage(v):
    return A.conversion_by_coverage(v.cytosine)


@question("a_meth_deciles", C, f"SELECT sample, chrom, FLOOR({FM} * 10) / 10.0 AS decile, COUNT(*) AS n FROM v_cytosine GROUP BY 1, 2, 3")
def meth_deciles(v):
    return A.methylation_deciles(v.cytosine, ["sample", "chrom"])


@question("a_depth_windows", "v_read", """
WITH z AS (SELECT chrom, max(start_pos) AS length FROM v_read GROUP BY 1), g AS (SELECT chrom, unnest(generate_series(0, length // 250)) * 250 AS "window" FROM z),
s AS (SELECT * FROM g, (VALUES ('+'), ('-')) AS t(strand)), c AS (SELECT chrom, start_pos // 250 * 250 AS "window", strand, COUNT(*) AS n FROM v_read GROUP BY 1, 2, 3)
SELECT s.chrom, CAST(s."window" AS BIGINT) AS "window", s.strand, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (chrom, "window", strand)""")
def depth_windows(v):
    sizes = v.read.groupBy("chrom").agg(F.max("start_pos").alias("length"))
    return A.depth_windows(v.read, sizes, 250, ["+", "-"])


@question("a_feature_size", FEAT, f"SELECT feat_type, COUNT(*) AS n, {BIG('end_pos - start_pos + 1')} AS bases FROM v_feature GROUP BY 1")
def feature_size(v):
    return A.feature_sizes(v.feature)


@question("a_feature_types", FEAT, "SELECT DISTINCT feat_type FROM v_feature")
def feature_types(v):
    return v.feature.select("feat_type").distinct()


@question("a_feature_overlap_counts", FEAT, """
WITH t AS (SELECT feat_type, COUNT(*) AS n_master FROM v_feature GROUP BY 1),
h AS (SELECT DISTINCT a.feat_type, a.feat_id, b.feat_type AS other_type FROM v_feature a JOIN v_feature b ON a.chrom = b.chrom AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos
  WHERE a.feat_type IN ('1-URGENT', '2-HIGH') AND b.feat_type IN ('1-URGENT', '3-MEDIUM') AND a.feat_type <> b.feat_type)
SELECT h.feat_type, other_type, COUNT(*) AS n_meeting, max(n_master) AS n_master, ROUND(COUNT(*) / CAST(max(n_master) AS DOUBLE), 6) AS share FROM h JOIN t USING (feat_type) GROUP BY 1, 2""")
def feature_overlap_counts(v):
    return rounded(A.overlap_type_counts(v.feature, ["1-URGENT", "2-HIGH"], ["1-URGENT", "3-MEDIUM"]), "share")


BASES_SQL = """SELECT chrom, p, SUM(CASE feat_type WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 4 END) AS mask FROM (
  SELECT DISTINCT chrom, feat_type, unnest(generate_series(start_pos, end_pos)) AS p FROM v_feature WHERE feat_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) GROUP BY 1, 2"""


@question("a_feature_venn_bp", FEAT, f"SELECT CAST(mask AS INT) AS mask, COUNT(*) AS bases FROM ({BASES_SQL}) GROUP BY 1")
def feature_venn_bp(v):
    return A.shared_bases(v.feature, TYPES)


@question("a_cpg_venn", BOTH, f"""
WITH b AS ({BASES_SQL}) SELECT sample, CAST(coalesce(mask, 0) AS INT) AS mask, COUNT(*) AS n, {BIG('c_reads + t_reads')} AS ct_reads
FROM v_cytosine c LEFT JOIN b ON b.chrom = c.chrom AND b.p = c.chrom_pos GROUP BY 1, 2""")
def cpg_venn(v):
    return A.cytosine_venn(v.cytosine, v.feature, TYPES)


PAIRS = f"""m AS (SELECT *, {FM} AS m FROM v_cytosine WHERE c_reads + t_reads > 0),
p AS (SELECT a.sample, b.chrom_pos - a.chrom_pos AS dist, a.m AS m1, b.m AS m2, a.strand = b.strand AS same FROM m a JOIN m b ON a.sample = b.sample AND a.chrom = b.chrom
  AND b.chrom_pos > a.chrom_pos AND b.chrom_pos <= a.chrom_pos + {{d}})"""


@question("a_autocorr_pearson", C, f"""
WITH {PAIRS.format(d=60)}, u AS (SELECT sample, dist, COUNT(*) AS n, avg(m2) AS mu, avg(m2 * m2) - avg(m2) * avg(m2) AS var FROM p GROUP BY 1, 2)
SELECT p.sample, CAST(p.dist AS BIGINT) AS dist, max(n) AS n, ROUND(CASE WHEN 2 * max(n) - 1 > 10 AND max(var) > 1e-12 THEN SUM((m1 - mu) * (m2 - mu)) / max(var) / (2 * max(n) - 1) END, 5) AS pearson
FROM p JOIN u ON u.sample = p.sample AND u.dist = p.dist GROUP BY 1, 2""")
def autocorr_pearson(v):
    return rounded(A.autocorr_pearson(v.cytosine, 60), "pearson", digits=5)


BIN3 = "CASE WHEN {m} < 0.2 THEN 0 WHEN {m} < 0.8 THEN 1 ELSE 2 END"


@question("a_autocorr_binned", C, f"""
WITH {PAIRS.format(d=40)}, k AS (SELECT sample, dist, {BIN3.format(m='m1')} AS b1, {BIN3.format(m='m2')} AS b2 FROM p),
u AS (SELECT sample, dist, b1, b2 FROM k UNION ALL SELECT sample, dist, b2, b1 FROM k), s AS (SELECT sample, dist, b1, COUNT(*) AS n_single FROM u GROUP BY 1, 2, 3)
SELECT u.sample, CAST(u.dist AS BIGINT) AS dist, u.b1 AS bin_1, u.b2 AS bin_2, COUNT(*) AS n_pair, max(n_single) AS n_single, ROUND(COUNT(*) / CAST(max(n_single) AS DOUBLE), 6) AS share
FROM u JOIN s ON s.sample = u.sample AND s.dist = u.dist AND s.b1 = u.b1 GROUP BY 1, 2, 3, 4""")
def autocorr_binned(v):
    return rounded(A.autocorr_binned(v.cytosine, 40, [0.0, 0.2, 0.8, 1.0]), "share")


@question("a_concordance", C, f"""
WITH {PAIRS.format(d=50)} SELECT sample, CAST(dist AS BIGINT) AS dist, COUNT(*) AS n, ROUND(avg(abs(m1 - m2)), 6) AS mean_diff, ROUND(avg(abs(m1 - m2)) FILTER (WHERE same), 6) AS mean_diff_same,
  ROUND(avg(abs(m1 - m2)) FILTER (WHERE NOT same), 6) AS mean_diff_opposite FROM p GROUP BY 1, 2""")
def concordance(v):
    return rounded(A.concordance(v.cytosine, 50), "mean_diff", "mean_diff_same", "mean_diff_opposite")


@question("a_autocorr_by_read", "v_base", f"""
WITH k AS ({CALLS_SQL}), p AS (SELECT b.chrom_pos - a.chrom_pos AS dist, a.meth AS m1, b.meth AS m2 FROM k a JOIN k b ON a.read_id = b.read_id AND b.chrom_pos > a.chrom_pos AND b.chrom_pos <= a.chrom_pos + 30)
SELECT CAST(dist AS BIGINT) AS dist, COUNT(*) FILTER (WHERE m1) AS n_m, COUNT(*) FILTER (WHERE NOT m1) AS n_u, COUNT(*) FILTER (WHERE m1 AND m2) AS n_mm, COUNT(*) FILTER (WHERE m1 AND NOT m2) AS n_mu,
  COUNT(*) FILTER (WHERE NOT m1 AND m2) AS n_um, COUNT(*) FILTER (WHERE NOT m1 AND NOT m2) AS n_uu FROM p GROUP BY 1""")
def autocorr_by_read(v):
    return A.autocorr_by_read(J.read_pairs(calls(v), 30))


ASM = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY chrom, chrom_pos ORDER BY a_c_reads + a_t_reads + b_c_reads + b_t_reads DESC, allele_pos) AS rn FROM v_allele
  WHERE a_base <> '0' AND b_base <> '0' AND a_c_reads + b_c_reads > 0 AND a_t_reads + b_t_reads > 0 AND a_c_reads + a_t_reads >= {m} AND b_c_reads + b_t_reads >= {m}
    AND a_reads_opp / CAST(nullif(total_reads_opp, 0) AS DOUBLE) <= 0.2 AND next_base_ref = 'G'),
k AS (SELECT * FROM o WHERE rn = 1 AND NOT (total_reads_opp <= 10 AND a_reads_opp > 1))"""


@question("a_asm_contingency", "v_allele", ASM.format(m=0) + " SELECT chrom, chrom_pos, allele_pos, a_c_reads, a_t_reads, b_c_reads, b_t_reads FROM k")
def asm_contingency(v):
    return A.contingency(v.allele).select("chrom", "chrom_pos", "allele_pos", "a_c_reads", "a_t_reads", "b_c_reads", "b_t_reads")


def _cells():
    return [F.col(c) for c in ("a_c_reads", "a_t_reads", "b_c_reads", "b_t_reads")]


@question("a_asm_chisq", "v_allele", ASM.format(m=1) + """, w AS (SELECT *, sqrt((b_c_reads + b_t_reads) / CAST(nullif(a_c_reads + a_t_reads, 0) AS DOUBLE)) AS w FROM k)
SELECT chrom, chrom_pos, allele_pos, ROUND(coalesce(pow(a_c_reads * w - b_c_reads / w, 2) / nullif(a_c_reads + b_c_reads, 0), 0) + coalesce(pow(a_t_reads * w - b_t_reads / w, 2) / nullif(a_t_reads + b_t_reads, 0), 0), 6) AS stat FROM w""")
def asm_chisq(v):
    k = A.contingency(v.allele, min_allele=1)
    return k.select("chrom", "chrom_pos", "allele_pos", near(A.chi_square_stat(*_cells()), 6).alias("stat"))


# the tail as an integral over an angle, by the trapezoid rule; independent of the series in the library
@question("a_asm_chisq_p", "v_allele", ASM.format(m=1) + """, w AS (SELECT *, sqrt((b_c_reads + b_t_reads) / CAST(nullif(a_c_reads + a_t_reads, 0) AS DOUBLE)) AS w FROM k),
s AS (SELECT chrom, chrom_pos, allele_pos, coalesce(pow(a_c_reads * w - b_c_reads / w, 2) / nullif(a_c_reads + b_c_reads, 0), 0) + coalesce(pow(a_t_reads * w - b_t_reads / w, 2) / nullif(a_t_reads + b_t_reads, 0), 0) AS stat FROM w),
u AS MATERIALIZED (SELECT DISTINCT stat FROM s),
p AS (SELECT stat, CASE WHEN stat < 1e-9 THEN -sqrt(2 * stat / pi()) / ln(10) ELSE (-stat / 2 + ln((0.5 + list_sum(list_transform(range(1, 6000), lambda i: exp(-stat / 2 * pow(tan(i * pi() / 12000), 2))))) / 6000)) / ln(10) END AS lp FROM u)
SELECT chrom, chrom_pos, allele_pos, ROUND(s.stat, 6) AS stat, ROUND(lp, 6) AS log10_p FROM s JOIN p ON p.stat = s.stat""")
def asm_chisq_p(v):
    k = A.contingency(v.allele, min_allele=1).withColumn("stat", A.chi_square_stat(*_cells()))
    return k.select("chrom", "chrom_pos", "allele_pos", near(F.col("stat"), 6).alias("stat"), near(A.chi_square_log10_p(F.col("stat")), 6).alias("log10_p"))


LF = "lgamma(CAST({x} + 1 AS DOUBLE))"


def _lp(k):
    terms = [("+", "a + b"), ("+", "c + d"), ("+", "a + c"), ("+", "b + d"), ("-", "a + b + c + d"), ("-", k), ("-", f"a + b - {k}"), ("-", f"a + c - {k}"), ("-", f"c + d - (a + c) + {k}")]
    return " ".join(f"{s} {LF.format(x='(' + x + ')')}" for s, x in terms).lstrip("+ ")


@question("a_asm_fisher", "v_allele", ASM.format(m=1) + f""", n AS (SELECT chrom, chrom_pos, allele_pos, a_c_reads AS a, a_t_reads AS b, b_c_reads AS c, b_t_reads AS d FROM k),
e AS (SELECT *, unnest(generate_series(greatest(0, a + c - (c + d)), least(a + b, a + c))) AS i FROM n),
s AS (SELECT chrom, chrom_pos, allele_pos, a, b, c, d, SUM(CASE WHEN {_lp('i')} <= {_lp('a')} + 1e-9 THEN exp({_lp('i')}) ELSE 0 END) AS p FROM e GROUP BY chrom, chrom_pos, allele_pos, a, b, c, d)
SELECT chrom, chrom_pos, allele_pos, ROUND(p, 6) AS p, ROUND(-log2(p), 5) AS neg_log2_p, ROUND(log2(greatest(a, c) / nullif(CASE WHEN a > c THEN a + b ELSE c + d END * (a + c) / CAST(a + b + c + d AS DOUBLE), 0)), 5) AS log_c,
  ROUND(log2(greatest(b, d) / nullif(CASE WHEN b > d THEN a + b ELSE c + d END * (b + d) / CAST(a + b + c + d AS DOUBLE), 0)), 5) AS log_t FROM s""")
def asm_fisher(v):
    k = A.contingency(v.allele, min_allele=1)
    p = A.fisher_two_tailed(*_cells())
    lc, lt = A.log_expectation(*_cells())
    out = k.select("chrom", "chrom_pos", "allele_pos", p.alias("p"), lc.alias("log_c"), lt.alias("log_t"))
    return rounded(rounded(out.withColumn("neg_log2_p", -F.log2("p")), "p"), "neg_log2_p", "log_c", "log_t", digits=5)


SNP = """n AS (SELECT chrom, pos, base, COUNT(*) AS n FROM v_base GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY n DESC, base) AS rn, SUM(n) OVER (PARTITION BY chrom, pos) AS depth FROM n),
k AS (SELECT chrom, pos, CAST(max(depth) AS BIGINT) AS depth, max(base) FILTER (WHERE rn = 1) AS base_1, max(n) FILTER (WHERE rn = 1) AS n_1, coalesce(max(n) FILTER (WHERE rn = 2), 0) AS n_2 FROM r GROUP BY 1, 2),
h AS (SELECT *, n_1 >= 1 AND depth - n_1 >= 1 AND (depth <= 10 OR (n_1 / CAST(depth AS DOUBLE) >= 0.2 AND n_2 / CAST(depth AS DOUBLE) >= 0.2)) AS het FROM k)"""


@question("a_snp_calls", "v_base", f"WITH {SNP} SELECT chrom, pos, depth, base_1, n_1, n_2, het FROM h")
def snp_calls(v):
    return A.snp_calls(v.tiled_bases(), min_count=1).select("chrom", "pos", "depth", "base_1", "n_1", "n_2", "het")


@question("a_confusion", "v_base v_allele", f"""
WITH {SNP}, t AS (SELECT DISTINCT b.chrom, b.pos, k.pos IS NOT NULL AS real_het FROM v_base b LEFT JOIN (SELECT DISTINCT chrom, allele_pos AS pos FROM v_allele) k ON k.chrom = b.chrom AND k.pos = b.pos),
g AS (SELECT COUNT(*) FILTER (WHERE het AND real_het) AS tp, COUNT(*) FILTER (WHERE NOT het AND NOT real_het) AS tn, COUNT(*) FILTER (WHERE het AND NOT real_het) AS fp, COUNT(*) FILTER (WHERE NOT het AND real_het) AS fn FROM h JOIN t USING (chrom, pos))
SELECT tp, tn, fp, fn, ROUND(fp / CAST(nullif(fp + tp, 0) AS DOUBLE), 6) AS fp_rate, ROUND(fn / CAST(nullif(fn + tp, 0) AS DOUBLE), 6) AS fn_rate FROM g""")
def confusion(v):
    known = v.allele.select("chrom", F.col("allele_pos").alias("pos"), F.lit(True).alias("_k")).distinct()
    truth = v.base.select("chrom", "pos").distinct().join(known, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("_k", F.lit(False)).alias("real_het"))
    return rounded(A.confusion(A.snp_calls(v.base, min_count=1), truth, ["chrom", "pos"], "het", "real_het"), "fp_rate", "fn_rate")


@question("a_element_enrichment", "v_read v_feature", """
WITH e AS (SELECT feat_type, chrom, start_pos, end_pos, 'i' AS part FROM v_feature UNION ALL SELECT feat_type, chrom, start_pos + CASE WHEN strand = '-' THEN 200 ELSE -200 END, end_pos + CASE WHEN strand = '-' THEN 200 ELSE -200 END, 'u' FROM v_feature),
n AS (SELECT e.feat_type, e.part, COUNT(*) AS n FROM e JOIN v_read r ON r.chrom = e.chrom AND r.start_pos BETWEEN e.start_pos AND e.end_pos GROUP BY 1, 2),
z AS (SELECT feat_type, part, SUM(end_pos - start_pos + 1) AS b FROM e GROUP BY 1, 2), d AS (SELECT z.feat_type, z.part, coalesce(n, 0) / CAST(b AS DOUBLE) AS d FROM z LEFT JOIN n ON n.feat_type = z.feat_type AND n.part = z.part)
SELECT feat_type, ROUND(max(d) FILTER (WHERE part = 'i'), 6) AS inside, ROUND(max(d) FILTER (WHERE part = 'u'), 6) AS upstream,
  ROUND(max(d) FILTER (WHERE part = 'i') / nullif(max(d) FILTER (WHERE part = 'u'), 0), 6) AS enrichment FROM d GROUP BY 1""")
def element_enrichment(v):
    return rounded(A.element_enrichment(v.read, v.feature, 200, "start_pos"), "inside", "upstream", "enrichment")


@question("a_transcripts_to_genes", FEAT, """
WITH x AS (SELECT feat_id // 12 AS gene_id, feat_id // 4 AS transcript_id, 'chr1' AS chrom, '+' AS strand, start_pos, end_pos FROM v_feature),
t AS (SELECT gene_id, transcript_id, chrom, strand, min(start_pos) AS s, max(end_pos) AS e, COUNT(*) AS n, concat(CAST(transcript_id AS VARCHAR), ':', string_agg(concat(CAST(start_pos AS VARCHAR), '-', CAST(end_pos AS VARCHAR)), ',' ORDER BY start_pos, end_pos)) AS iso FROM x GROUP BY 1, 2, 3, 4)
SELECT gene_id, chrom, strand, min(s) AS start_pos, max(e) AS end_pos, COUNT(*) AS n_isoforms, CAST(SUM(n) AS BIGINT) AS n_exons, string_agg(iso, ';' ORDER BY iso) AS isoforms FROM t GROUP BY 1, 2, 3""")
def transcripts_to_genes(v):
    x = v.feature.select(F.floor(F.col("feat_id") / 12).alias("gene_id"), F.floor(F.col("feat_id") / 4).alias("transcript_id"), F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"), "start_pos", "end_pos")
    return A.transcripts_to_genes(x)


@question("a_sample_spread", C, f"""
SELECT chrom, chrom_pos, COUNT(m) AS n, ROUND(var_pop(m), 6) AS variance, ROUND(max(m) - min(m), 6) AS delta FROM (SELECT *, {FM} AS m FROM v_cytosine) GROUP BY 1, 2""")
def sample_spread(v):
    return rounded(A.sample_spread(v.cytosine), "variance", "delta")
