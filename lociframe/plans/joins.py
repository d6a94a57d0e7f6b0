"""Joins over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import methylation as M
from lociframe.functions import sequence as Q
from lociframe.operators import joins as J
from lociframe.operators import rangejoin as R
from lociframe.operators.piles import place
from lociframe.plans.registry import PART_BYTES, near, question
from lociframe.plans.scans import READS_SQL, call_columns, read_cytosines

C, FEAT = "v_cytosine", "v_feature"
COVER = "EXISTS (SELECT 1 FROM v_feature f WHERE f.feat_type = '{t}' AND f.chrom = c.chrom AND c.chrom_pos BETWEEN f.start_pos - {k} AND f.end_pos + {k})"


def typed(v, t):
    return v.feature.filter(F.col("feat_type") == t)


@question("j_multisample", C, """
SELECT a.chrom, a.chrom_pos, a.c_reads AS c_reads_A, a.t_reads AS t_reads_A, b.c_reads AS c_reads_B, b.t_reads AS t_reads_B
FROM v_cytosine a JOIN v_cytosine b ON a.chrom = b.chrom AND a.chrom_pos = b.chrom_pos
WHERE a.sample = 'A' AND b.sample = 'B' AND a.c_reads + a.t_reads >= 2 AND b.c_reads + b.t_reads >= 2""")
def multisample(v):
    return J.align_samples(v.cytosine.filter(M.min_ct(2)), ["A", "B"], ["c_reads", "t_reads"])


@question("j_within_feature", [C, FEAT][0] + " " + FEAT, "SELECT sample, chrom, chrom_pos, c_reads, t_reads FROM v_cytosine c WHERE c.c_reads + c.t_reads >= 4 AND (total_reads_opp = 0 OR a_reads_opp / CAST(total_reads_opp AS DOUBLE) <= 0.2) AND " + COVER.format(t="1-URGENT", k=10))
def within_feature(v):
    d = v.cytosine.filter(M.min_ct(4) & M.opp_a_ok(0.2))
    return J.within_features(d, v.feature, ["1-URGENT"], 10).select("sample", "chrom", "chrom_pos", "c_reads", "t_reads")


@question("j_within_all_features", f"{C} {FEAT}", "SELECT sample, chrom, chrom_pos FROM v_cytosine c WHERE " + " AND ".join(
    COVER.format(t=t, k=20) for t in ("1-URGENT", "2-HIGH", "5-LOW")))
def within_all_features(v):
    return J.within_features(v.cytosine, v.feature, ["1-URGENT", "2-HIGH", "5-LOW"], 20).select("sample", "chrom", "chrom_pos")


OVER = "EXISTS (SELECT 1 FROM v_feature b WHERE b.feat_type = '2-HIGH' AND b.chrom = a.chrom AND b.start_pos <= a.end_pos + {k} AND b.end_pos >= a.start_pos - {k}{s})"


@question("j_feature_overlap", FEAT, "SELECT feat_id, chrom, start_pos, end_pos FROM v_feature a WHERE feat_type = '1-URGENT' AND " + OVER.format(k=0, s=""))
def feature_overlap(v):
    return J.overlap_filter(typed(v, "1-URGENT"), typed(v, "2-HIGH")).select("feat_id", "chrom", "start_pos", "end_pos")


@question("j_overlap_stranded", FEAT, "SELECT feat_id, chrom, strand FROM v_feature a WHERE feat_type = '1-URGENT' AND " + OVER.format(k=15, s=" AND b.strand = a.strand"))
def overlap_stranded(v):
    return J.overlap_filter(typed(v, "1-URGENT"), typed(v, "2-HIGH"), 15, same_strand=True).select("feat_id", "chrom", "strand")


@question("j_overlap_pairs", FEAT, """
SELECT a.feat_id AS id_a, b.feat_id AS id_b, a.chrom, CAST(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) + 1 AS BIGINT) AS shared
FROM v_feature a JOIN v_feature b ON a.chrom = b.chrom AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos
WHERE a.feat_type = '3-MEDIUM' AND b.feat_type = '5-LOW'""")
def overlap_pairs(v):
    side = lambda t, n: typed(v, t).select("chrom", F.col("feat_id").alias(f"id_{n}"), F.col("start_pos").alias(f"s_{n}"), F.col("end_pos").alias(f"e_{n}"))
    p = R.overlap_pairs(side("3-MEDIUM", "a"), side("5-LOW", "b"), ["chrom"], ("s_a", "e_a"), ("s_b", "e_b"), width=32)
    return p.select("id_a", "id_b", "chrom", (F.least("e_a", "e_b") - F.greatest("s_a", "s_b") + 1).cast("bigint").alias("shared"))


@question("j_feature_anti", FEAT, "SELECT feat_id, chrom, start_pos, end_pos FROM v_feature a WHERE feat_type = '1-URGENT' AND NOT " + OVER.format(k=5, s=""))
def feature_anti(v):
    return J.overlap_filter(typed(v, "1-URGENT"), typed(v, "2-HIGH"), 5, how="anti").select("feat_id", "chrom", "start_pos", "end_pos")


@question("j_nearest_feature", FEAT, """
WITH p AS (SELECT t.feat_id, f.feat_id AS near_id, f.start_pos AS fs, f.end_pos AS fe,
  CASE WHEN f.start_pos > t.end_pos THEN (t.end_pos - f.start_pos) * CASE WHEN f.strand = '-' THEN -1 ELSE 1 END
       WHEN f.end_pos < t.start_pos THEN (t.start_pos - f.end_pos) * CASE WHEN f.strand = '-' THEN -1 ELSE 1 END ELSE 0 END AS dist
  FROM v_feature t JOIN v_feature f ON f.chrom = t.chrom AND f.feat_type = '2-HIGH' AND f.start_pos <= t.end_pos + 100 AND f.end_pos >= t.start_pos - 100
  WHERE t.feat_type = '1-URGENT'),
r AS (SELECT *, row_number() OVER (PARTITION BY feat_id ORDER BY abs(dist), fs, fe DESC, near_id) AS rn FROM p)
SELECT t.feat_id, r.near_id, CAST(r.dist AS BIGINT) AS dist FROM v_feature t LEFT JOIN r ON r.feat_id = t.feat_id AND rn = 1 WHERE t.feat_type = '1-URGENT'""")
def nearest_feature(v):
    return J.nearest(typed(v, "1-URGENT"), typed(v, "2-HIGH"), 100).select("feat_id", "near_id", F.col("dist").cast("bigint").alias("dist"))


@question("j_reorient", FEAT, """
WITH o AS (SELECT *, concat('g', CAST(feat_id % 50 AS VARCHAR)) AS name FROM v_feature WHERE feat_type = '3-MEDIUM'),
h AS (SELECT t.feat_id, bool_or(o.strand = '+') AS fw, bool_or(o.strand = '-') AS rev, min(o.name) AS n1, max(o.name) AS n2
  FROM v_feature t JOIN o ON o.chrom = t.chrom AND o.start_pos - 10 <= t.end_pos AND o.end_pos + 10 >= t.start_pos WHERE t.feat_type = '5-LOW' GROUP BY 1)
SELECT t.feat_id, CASE WHEN fw AND NOT rev THEN '+' WHEN rev AND NOT fw THEN '-' ELSE '.' END AS new_strand, CASE WHEN n1 = n2 THEN n1 END AS new_name
FROM v_feature t LEFT JOIN h ON h.feat_id = t.feat_id WHERE t.feat_type = '5-LOW'""")
def reorient(v):
    o = typed(v, "3-MEDIUM").withColumn("name", F.concat(F.lit("g"), (F.col("feat_id") % 50).cast("string")))
    return J.reorient(typed(v, "5-LOW"), o, 10).select("feat_id", "new_strand", "new_name")


EXPR_SQL = """SELECT CAST(c_nationkey AS BIGINT) AS refseq_id, avg(c_acctbal) AS mean_normal, max(c_acctbal) AS mean_tumor,
  (c_nationkey % 10) / 10.0 AS pctile_normal, (c_nationkey * 7 % 10) / 10.0 AS pctile_tumor, (c_nationkey % 4) / 50.0 AS ttest FROM {customer} GROUP BY c_nationkey"""


def expression(v):
    return v.spark.sql(EXPR_SQL, customer=v.customer)


@question("j_feature_expression", FEAT, "WITH e AS (" + EXPR_SQL.format(customer="customer") + """),
k AS (SELECT e.refseq_id, f.name FROM e, (VALUES ('tumHigh'), ('tumLow'), ('normHigh'), ('tumUp')) AS f(name)
  WHERE (f.name = 'tumHigh' AND pctile_tumor > 0.667) OR (f.name = 'tumLow' AND pctile_tumor < 0.333)
     OR (f.name = 'normHigh' AND pctile_normal > 0.667) OR (f.name = 'tumUp' AND ttest < 0.05 AND mean_tumor > mean_normal))
SELECT f.feat_id, concat(f.feat_type, '_', k.name) AS feat_type FROM (SELECT *, feat_id % 25 AS refseq_id FROM v_feature) f JOIN k USING (refseq_id)""")
def feature_expression(v):
    f = v.feature.withColumn("refseq_id", F.col("feat_id") % 25)
    return J.feature_expression(f, expression(v), ["tumHigh", "tumLow", "normHigh", "tumUp"]).select("feat_id", "feat_type")


@question("j_expression_mean", FEAT, """
SELECT f.feat_id, ROUND(e.m, 4) AS expression FROM v_feature f LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) e
ON e.c_nationkey = f.feat_id % 30""")
def expression_mean(v):
    f = v.feature.withColumn("refseq_id", F.col("feat_id") % 30)
    e = v.customer.select(F.col("c_nationkey").cast("bigint").alias("refseq_id"), "c_acctbal")
    return J.with_expression(f, e, "c_acctbal").select("feat_id", near(F.col("expression"), 4).alias("expression"))


@question("j_merge_by_id", "", """
WITH a AS (SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS first_line FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
b AS (SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS other_line FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, a.first_line, b.other_line FROM lineitem l JOIN a USING (l_suppkey, l_partkey) JOIN b USING (l_suppkey, l_partkey)
WHERE l.l_returnflag = 'N'""")
def merge_by_id(v):
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    part = lambda flag, name: v.lineitem.filter(F.col("l_returnflag") == flag).select("l_suppkey", "l_partkey", line.alias(name), line.alias("rank"))
    last = v.lineitem.filter(F.col("l_returnflag") == "N").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    out = J.merge_by_id(last, [part("R", "first_line"), part("A", "other_line")], ["l_suppkey", "l_partkey"], "rank")
    return out.select("l_orderkey", "l_linenumber", "first_line", "other_line")


@question("j_scores_default", FEAT, """
SELECT f.feat_id, coalesce(s.c_acctbal, -1.0) AS score FROM (SELECT feat_id, concat('customer#', lpad(CAST(feat_id % (SELECT 2 * COUNT(*) FROM customer) AS VARCHAR), 9, '0')) AS name FROM v_feature) f
LEFT JOIN customer s ON upper(s.c_name) = upper(f.name)""")
def scores_default(v):
    n = v.customer.agg(2 * F.count(F.lit(1))).scalar()  # half of the names are known
    f = v.feature.select("feat_id", F.concat(F.lit("customer#"), F.lpad((F.col("feat_id") % n).cast("string"), 9, "0")).alias("name"))
    s = v.customer.select(F.col("c_name").alias("name"), "c_acctbal")
    return J.scores_or_default(f, s, "name", "c_acctbal", -1.0).select("feat_id", "score")


@question("j_align_to_master", "", """
WITH t AS (SELECT o_custkey, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c LEFT JOIN t ON t.o_custkey = c.c_custkey AND rn = 1""")
def align_to_master(v):
    t = v.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", F.struct("o_totalprice", "o_orderkey").alias("best"))
    return J.align_to_master(v.customer.select("c_custkey"), t, "c_custkey", "best").select("c_custkey", "o_orderkey", "o_totalprice")


@question("j_merge_replicates", C, """
WITH ref AS (SELECT DISTINCT chrom, CAST(chrom_pos // 4 * 4 AS INT) AS chrom_pos FROM v_cytosine),
z AS (SELECT chrom, chrom_pos, '+' AS s FROM ref UNION ALL SELECT chrom, chrom_pos + 1, '-' FROM ref),
u AS (SELECT chrom, chrom_pos, strand, CAST(NULL AS VARCHAR) AS s, c_reads, t_reads FROM v_cytosine UNION ALL SELECT chrom, chrom_pos, NULL, s, 0, 0 FROM z)
SELECT chrom, chrom_pos, coalesce(min(strand), min(s)) AS strand, CAST(SUM(c_reads) AS BIGINT) AS c_reads, CAST(SUM(t_reads) AS BIGINT) AS t_reads,
  bool_or(s IS NOT NULL) AS in_reference FROM u GROUP BY 1, 2""")
def merge_replicates(v):
    c = v.cytosine
    ref = c.select("chrom", (F.floor(F.col("chrom_pos") / 4) * 4).cast("int").alias("chrom_pos")).distinct()
    parts = [c.filter(F.col("sample") == s) for s in ("A", "B")]
    return J.merge_replicates(parts, ["c_reads", "t_reads"], ref)


@question("j_allpairs", C, """
SELECT a.sample, a.chrom, a.chrom_pos AS pos_1, b.chrom_pos AS pos_2, a.strand = b.strand AS same_strand
FROM v_cytosine a JOIN v_cytosine b ON a.sample = b.sample AND a.chrom = b.chrom AND b.chrom_pos > a.chrom_pos AND b.chrom_pos <= a.chrom_pos + 30""")
def allpairs(v):
    p = R.pairs_within(v.cytosine, 30, ["sample", "chrom"], "chrom_pos", ["strand"])
    return p.select("sample", "chrom", "pos_1", "pos_2", (F.col("strand_1") == F.col("strand_2")).alias("same_strand"))


def calls(v, base=None):
    k = read_cytosines(v.base if base is None else base)
    return k.select("read_id", *[c for c in ("chrom", "tile", "home") if c in k.columns], "strand", "chrom_pos", (F.col("c_reads") + F.col("c_reads_nonconv") > 0).alias("meth"))


CALLS_SQL = f"SELECT read_id, chrom, strand, chrom_pos, c_reads + c_reads_nonconv > 0 AS meth FROM ({READS_SQL}) q"


@question("j_pairs_by_read", "v_base", f"""
WITH k AS ({CALLS_SQL}),
p AS (SELECT *, unnest(list({{'p': chrom_pos, 'm': meth}}) OVER (PARTITION BY read_id ORDER BY chrom_pos RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING)) AS b FROM k)
SELECT read_id, chrom, strand, chrom_pos AS pos_1, b.p AS pos_2, meth AS meth_1, b.m AS meth_2 FROM p""")
def pairs_by_read(v):
    return J.read_pairs(calls(v), 12).select("read_id", "chrom", "strand", "pos_1", "pos_2", "meth_1", "meth_2")


@question("j_pairs_other_read", "v_base", f"""
WITH k AS ({CALLS_SQL}),
p AS (SELECT a.read_id AS read_id_1, b.read_id AS read_id_2, a.chrom, a.strand, a.chrom_pos AS pos_1, b.chrom_pos AS pos_2, a.meth AS meth_1, b.meth AS meth_2,
  row_number() OVER (PARTITION BY a.read_id, a.chrom, a.strand, a.chrom_pos, b.chrom_pos ORDER BY b.read_id) AS rn
  FROM k a JOIN k b ON a.chrom = b.chrom AND a.strand = b.strand AND b.chrom_pos > a.chrom_pos AND b.chrom_pos <= a.chrom_pos + 8 AND a.read_id <> b.read_id)
SELECT read_id_1, read_id_2, chrom, strand, pos_1, pos_2, meth_1, meth_2 FROM p WHERE rn = 1""")
def pairs_other_read(v):
    return J.read_pairs(calls(v, v.tiled_bases(8)), 8, "different").select("read_id_1", "read_id_2", "chrom", "strand", "pos_1", "pos_2", "meth_1", "meth_2")


@question("j_pairs_across_boundary", f"{C} {FEAT}", """
WITH f AS (SELECT * FROM v_feature WHERE feat_type = '1-URGENT'),
h AS (SELECT c.sample, c.chrom, c.chrom_pos, f.start_pos, f.end_pos, row_number() OVER (PARTITION BY c.sample, c.chrom, c.chrom_pos ORDER BY f.start_pos, f.end_pos DESC) AS rn
  FROM v_cytosine c JOIN f ON f.chrom = c.chrom AND c.chrom_pos BETWEEN f.start_pos AND f.end_pos),
m AS (SELECT c.sample, c.chrom, c.chrom_pos, h.start_pos AS s, h.end_pos AS e FROM v_cytosine c LEFT JOIN h ON h.sample = c.sample AND h.chrom = c.chrom AND h.chrom_pos = c.chrom_pos AND rn = 1)
SELECT sample, chrom, chrom_pos AS pos_1, b.p AS pos_2, b.p - chrom_pos AS dist, CASE WHEN s IS NOT NULL THEN b.p - e ELSE b.s - chrom_pos END AS edge_dist
FROM (SELECT *, unnest(list({'p': chrom_pos, 's': s}) OVER (PARTITION BY sample, chrom ORDER BY chrom_pos RANGE BETWEEN 1 FOLLOWING AND 25 FOLLOWING)) AS b FROM m) WHERE (s IS NULL) <> (b.s IS NULL)""")
def pairs_across_boundary(v):
    return J.pairs_across_boundary(v.cytosine.select("sample", "chrom", "chrom_pos"), typed(v, "1-URGENT"), 25)


@question("j_collapse_strands", C, """
SELECT sample, chrom, chrom_pos - CASE WHEN strand = '-' THEN 1 ELSE 0 END AS chrom_pos, CAST(SUM(c_reads) AS BIGINT) AS c_reads, CAST(SUM(t_reads) AS BIGINT) AS t_reads, COUNT(*) AS n_strands
FROM v_cytosine GROUP BY 1, 2, 3""")
def collapse_strands(v):
    return J.collapse_strands(v.cytosine, ["c_reads", "t_reads"])


@question("j_compare_full_outer", "v_read", """
WITH a AS (SELECT read_id, chrom, start_pos FROM v_read WHERE mapq >= 10), b AS (SELECT read_id, chrom, CASE WHEN read_id % 7 = 0 THEN start_pos + 1 ELSE start_pos END AS start_pos FROM v_read WHERE mapq <= 30)
SELECT read_id, CASE WHEN a.chrom IS NULL THEN 'missing1' WHEN b.chrom IS NULL THEN 'missing2' WHEN a.start_pos = b.start_pos AND a.chrom = b.chrom THEN 'match' ELSE 'mismatch' END AS code
FROM a FULL OUTER JOIN b USING (read_id)""")
def compare_full_outer(v):
    a = v.read.filter(F.col("mapq") >= 10)
    b = v.read.filter(F.col("mapq") <= 30).withColumn("start_pos", F.when(F.col("read_id") % 7 == 0, F.col("start_pos") + 1).otherwise(F.col("start_pos")))
    return J.compare_sets(a, b, "read_id", ["chrom", "start_pos"])


BLOCK_SQL = """SELECT chrom, snp_pos, SUM(n) AS n_cpg, CASE WHEN SUM(t) = 0 THEN 'Inf' WHEN SUM(c) = 0 THEN '-Inf' ELSE CAST(CAST(FLOOR(SUM(c) * 10 / SUM(t)) AS BIGINT) - 10 AS {S}) END AS log2_ratio,
  SUM(a) % 20 / 1000.0 AS p_adj FROM (SELECT chrom, CAST(FLOOR(chrom_pos / 10) AS BIGINT) AS snp_pos, 1 AS n, c_reads AS c, t_reads AS t, ag_reads + total_reads_opp AS a FROM {src} WHERE sample = '{s}') q GROUP BY 1, 2"""


@question("j_asm_overlap", C, f"""
WITH n AS ({BLOCK_SQL.format(S='VARCHAR', src='v_cytosine', s='A')}), t AS ({BLOCK_SQL.format(S='VARCHAR', src='v_cytosine', s='B')}),
ns AS (SELECT *, (log2_ratio IN ('NA', 'Inf', '-Inf') OR abs(TRY_CAST(log2_ratio AS DOUBLE)) >= 1) AND p_adj < 0.01 AS sig FROM n WHERE n_cpg >= 2),
ts AS (SELECT *, (log2_ratio IN ('NA', 'Inf', '-Inf') OR abs(TRY_CAST(log2_ratio AS DOUBLE)) >= 1) AND p_adj < 0.01 AS sig FROM t WHERE n_cpg >= 2)
SELECT chrom, snp_pos, CASE WHEN ns.sig AND ts.sig THEN 'overlap' WHEN ns.sig THEN 'normal_only' WHEN ts.sig THEN 'tumor_only' ELSE 'none' END AS kind
FROM ns JOIN ts USING (chrom, snp_pos)""")
def asm_overlap(v):
    side = lambda s: v.spark.sql(BLOCK_SQL.format(S="STRING", src="{src}", s=s), src=v.cytosine)
    return J.block_overlap(side("A"), side("B"), 2, 0.01, 2.0)


@question("j_allele_specific", "v_base", f"""
WITH k AS ({READS_SQL}), s AS (SELECT read_id, pos AS snp_pos, base FROM v_base JOIN (SELECT chrom, pos FROM v_base GROUP BY 1, 2 HAVING COUNT(DISTINCT base) > 1) USING (chrom, pos))
SELECT k.chrom, k.chrom_pos, k.strand, s.snp_pos, s.base, CAST(SUM(c_reads + c_reads_nonconv) AS BIGINT) AS c_reads, CAST(SUM(t_reads) AS BIGINT) AS t_reads
FROM k JOIN s ON s.read_id = k.read_id AND k.chrom_pos <> s.snp_pos AND abs(k.chrom_pos - s.snp_pos) <= 50 GROUP BY 1, 2, 3, 4, 5""")
def allele_specific(v):
    base = v.tiled_bases(50, PART_BYTES // 4)  # a base has up to a hundred others within reach
    call, n = call_columns()
    return J.allele_counts(base.select("read_id", *place(base), "strand", "base", call.alias("call"), (n["c_reads"] + n["c_reads_nonconv"]).alias("c"), n["t_reads"].alias("t")), 50)


@question("j_feature_offset", f"{C} {FEAT}", """
WITH f AS (SELECT *, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS ref_point FROM v_feature)
SELECT c.sample, c.chrom, c.chrom_pos, f.feat_id, CASE WHEN f.strand = '-' THEN ref_point - c.chrom_pos ELSE c.chrom_pos - ref_point END AS "offset"
FROM v_cytosine c JOIN f ON f.chrom = c.chrom AND c.chrom_pos BETWEEN ref_point - 10 AND ref_point + 10""")
def feature_offset(v):
    out = J.offsets_to_features(v.cytosine, v.feature, 10, "chrom_pos", "start")
    return out.select("sample", "chrom", "chrom_pos", "feat_id", "offset")


@question("j_inverted_pairs", "v_alignment", """
WITH m AS (SELECT CAST(read_id // 40 AS BIGINT) AS read_name, 1 + (read_id // 20) % 2 AS mate, seq FROM v_alignment),
b AS (SELECT read_name, max(CASE WHEN mate = 1 THEN substring(seq, 1, 20) END) AS a, max(CASE WHEN mate = 2 THEN substring(seq, 1, 20) END) AS b FROM m GROUP BY 1)
SELECT read_name, CAST(hamming(a, b) AS INT) AS mismatches, hamming(a, b) <= 12 AS inverted FROM b WHERE a IS NOT NULL AND b IS NOT NULL""")
def inverted_pairs(v):
    m = v.alignment.select(F.floor(F.col("read_id") / 40).alias("read_name"), (1 + F.floor(F.col("read_id") / 20) % 2).alias("mate"), "seq")
    return J.inverted_pairs(m, 20, 12)


@question("j_island_flag", f"{C} {FEAT}", "SELECT sample, chrom, chrom_pos, " + COVER.format(t="2-HIGH", k=0) + " AS in_island FROM v_cytosine c")
def island_flag(v):
    return J.island_flag(v.cytosine, typed(v, "2-HIGH")).select("sample", "chrom", "chrom_pos", "in_island")


@question("j_orient_by_motif", f"{FEAT} v_seq", """
WITH s AS (SELECT f.feat_id, substring(q.seq, CAST(1 + f.start_pos % greatest(length(q.seq) - 18, 1) AS INT), 19) AS sub FROM v_feature f JOIN v_seq q ON q.seq_id = f.feat_id % (SELECT COUNT(*) FROM documents)),
r AS (SELECT feat_id, sub, reverse(translate(sub, 'ACGT', 'TGCA')) AS rc FROM s),
m AS (SELECT * FROM (VALUES (5, 'CA'), (9, 'AG'), (15, 'CA')) AS m(p, b)),
n AS (SELECT feat_id, SUM(CASE WHEN substring(sub, p, 2) = b THEN 2 ELSE 0 END) - SUM(CASE WHEN substring(rc, p, 2) = b THEN 2 ELSE 0 END) AS d FROM r, m GROUP BY 1)
SELECT feat_id, CASE WHEN d >= 2 THEN '+' WHEN d <= -2 THEN '-' ELSE '.' END AS new_strand FROM n""")
def orient_by_motif(v):
    n = v.documents.agg(F.count(F.lit(1))).scalar()
    f = v.feature.withColumn("seq_id", F.col("feat_id") % n).join(v.seq.select("seq_id", "seq"), "seq_id")
    sub = F.substring(F.col("seq"), (1 + F.col("start_pos") % F.greatest(F.length("seq") - 18, F.lit(1))).cast("int"), F.lit(19))
    return f.select("feat_id", Q.strand_by_evidence(sub, margin=2).alias("new_strand"))


@question("p_mismatch_cycles", "v_alignment", """
SELECT read_id, CAST(hamming(substring(seq, 11, 30), substring(ref, 11, 30)) AS INT) AS mismatches FROM v_alignment WHERE read_id % 3 <> 0""")
def mismatch_cycles(v):
    other = v.alignment.filter(F.col("read_id") % 3 != 0).select("read_id", F.col("ref").alias("seq"))
    return J.mismatches_between(v.alignment, other, "read_id", 11, 40)


@question("j_cpg_pairs", C, """
WITH f AS (SELECT *, c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE) AS m, c_reads + t_reads AS d FROM v_cytosine)
SELECT a.sample, a.chrom, a.chrom_pos, a.d AS depth_fw, b.d AS depth_rev, a.d + b.d AS depth, least(a.d, b.d) AS min_depth, ROUND(a.m, 6) AS meth_fw, ROUND(b.m, 6) AS meth_rev,
  ROUND((a.c_reads + b.c_reads) / CAST(nullif(a.d + b.d, 0) AS DOUBLE), 6) AS meth, ROUND(abs(a.m - b.m), 6) AS strand_diff
FROM f a JOIN f b ON a.sample = b.sample AND a.chrom = b.chrom AND b.chrom_pos = a.chrom_pos + 1 AND a.strand = '+' AND b.strand = '-'""")
def cpg_pairs(v):
    out = J.cpg_pairs(v.cytosine)
    return out.withColumns({c: near(F.col(c)) for c in ("meth_fw", "meth_rev", "meth", "strand_diff")})
