"""Filters and scalar functions over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import intervals as I
from lociframe.functions import methylation as M
from lociframe.functions import sequence as Q
from lociframe.operators import lookups
from lociframe.operators import readlevel as R
from lociframe.plans.registry import near, question
from lociframe.sources import cytosines

FM = "c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE)"


@question("f_ranges", "v_cytosine", """
SELECT sample, chrom, chrom_pos FROM v_cytosine
WHERE (chrom = 'chr1' AND chrom_pos BETWEEN 100 AND 5000) OR (chrom = 'chr1' AND chrom_pos BETWEEN 4000 AND 9000)
   OR (chrom = 'chr4' AND chrom_pos BETWEEN 1 AND 12000)""")
def f_ranges(v):
    spans = [("chr1", 100, 5000), ("chr1", 4000, 9000), ("chr4", 1, 12000)]
    return v.cytosine.filter(cytosines.in_ranges(spans)).select("sample", "chrom", "chrom_pos")


@question("f_min_ct", "v_cytosine", """
SELECT sample, chrom, chrom_pos, c_reads + t_reads >= 8 AS with_filter FROM v_cytosine
WHERE c_reads + t_reads + c_reads_nonconv >= 8""")
def f_min_ct(v):
    return v.cytosine.filter(M.min_ct(8, False)).select("sample", "chrom", "chrom_pos", M.min_ct(8).alias("with_filter"))


@question("f_opp_a", "v_cytosine", """
SELECT sample, chrom, chrom_pos FROM v_cytosine
WHERE total_reads_opp = 0 OR a_reads_opp / CAST(total_reads_opp AS DOUBLE) <= 0.101""")
def f_opp_a(v):
    return v.cytosine.filter(M.opp_a_ok()).select("sample", "chrom", "chrom_pos")


@question("f_next_g", "v_cytosine", """
SELECT sample, chrom, chrom_pos FROM (SELECT *, t_reads AS next_base_g, t_reads + ag_reads AS next_base_total FROM v_cytosine)
WHERE next_base_total = 0 OR next_base_g / CAST(next_base_total AS DOUBLE) >= 1 - 0.101""")
def f_next_g(v):
    d = v.cytosine.withColumn("next_base_g", F.col("t_reads")).withColumn("next_base_total", F.col("t_reads") + F.col("ag_reads"))
    return d.filter(M.next_g_ok()).select("sample", "chrom", "chrom_pos")


@question("f_mutation", "v_cytosine", """
SELECT sample, chrom, chrom_pos FROM v_cytosine
WHERE NOT (a_reads_opp >= 2 AND coalesce(a_reads_opp / CAST(nullif(a_reads_opp + total_reads_opp, 0) AS DOUBLE), -1) >= 0.2)""")
def f_mutation(v):
    return v.cytosine.filter(M.not_mutated()).select("sample", "chrom", "chrom_pos")


@question("f_is_cph", "v_cytosine", """
WITH d AS (SELECT sample, chrom, chrom_pos, CASE chrom_pos % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'A' WHEN 2 THEN 'C' ELSE 'T' END AS b,
  t_reads AS g, t_reads + ag_reads AS n FROM v_cytosine)
SELECT sample, chrom, chrom_pos, b <> 'G' AS by_ref, CASE WHEN n > 0 THEN g / CAST(n AS DOUBLE) < 0.5 ELSE b <> 'G' END AS by_reads FROM d""")
def f_is_cph(v):
    nxt = F.element_at(F.array(*map(F.lit, "GACT")), F.col("chrom_pos") % 4 + 1)
    d = v.cytosine.withColumns({"next_base_ref": nxt, "next_base_g": F.col("t_reads"),
                                "next_base_total": F.col("t_reads") + F.col("ag_reads")})
    return d.select("sample", "chrom", "chrom_pos", M.is_cph(True).alias("by_ref"), M.is_cph(False).alias("by_reads"))


@question("f_read_valid", "v_base", """
SELECT read_id, pos, b IN ('C', 'T') AND nxt = 'G' AND NOT (b = 'C' AND qual < 10) AS valid_cg, b = 'C' AND qual >= 10 AS meth
FROM (SELECT *, CASE strand WHEN '+' THEN base ELSE translate(base, 'ACGT', 'TGCA') END AS b, CASE strand WHEN '+' THEN next_ref ELSE translate(prev_ref, 'ACGT', 'TGCA') END AS nxt FROM v_base) WHERE ref_base = CASE strand WHEN '+' THEN 'C' ELSE 'G' END AND nxt IS NOT NULL""")
def f_read_valid(v):
    plus = F.col("strand") == "+"  # the cytosine is on the read's own strand
    along = lambda fw, rev: F.when(plus, F.col(fw)).otherwise(Q.complement(F.col(rev)))
    b = v.base.filter(F.col("ref_base") == F.when(plus, "C").otherwise("G")).withColumns({"b": along("base", "base"), "nxt": along("next_ref", "prev_ref")})
    late = (F.col("b") == "C") & (F.col("qual") < 10)
    valid = F.col("b").isin("C", "T") & (F.col("nxt") == "G") & ~late
    return b.filter(F.col("nxt").isNotNull()).select("read_id", "pos", valid.alias("valid_cg"), ((F.col("b") == "C") & (F.col("qual") >= 10)).alias("meth"))


@question("f_context_class", "v_base", """
WITH r AS (SELECT DISTINCT chrom, pos, ref_base FROM v_base),
n AS (SELECT *, max(ref_base) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS n1,
  max(ref_base) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) AS n2 FROM r)
SELECT chrom, pos, CASE WHEN n1 = 'G' THEN 'CG' WHEN n1 IS NULL OR n2 IS NULL THEN 'C' WHEN n2 = 'G' THEN 'CHG' ELSE 'CHH' END AS context
FROM n WHERE ref_base = 'C'""")
def f_context_class(v):
    refs = v.base.select("chrom", "pos", "ref_base").distinct()
    n = lookups.base_neighbours(refs, 0, 2).filter(F.col("ref_base") == "C")
    return n.select("chrom", "pos", Q.context_class(F.col("ref_base"), F.col("ref_base_p1"), F.col("ref_base_p2")).alias("context"))


@question("f_nmer", "v_base", """
WITH r AS (SELECT DISTINCT chrom, pos, ref_base FROM v_base)
SELECT chrom, pos FROM (SELECT *, max(ref_base) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS n1,
  max(ref_base) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) AS n2 FROM r) WHERE ref_base = 'G' AND n1 = 'C' AND n2 = 'A'""")
def f_nmer(v):
    n = lookups.base_neighbours(v.tiled_bases(2).select("chrom", "tile", "home", "pos", "ref_base").distinct(), 0, 2)
    return n.filter(F.concat("ref_base", "ref_base_p1", "ref_base_p2") == "GCA").select("chrom", "pos")


@question("f_min_depth", "v_base", """
SELECT chrom, pos, CAST(SUM(CASE WHEN strand = '+' THEN 1 ELSE 0 END) AS BIGINT) AS depth_fw,
  CAST(SUM(CASE WHEN strand = '-' THEN 1 ELSE 0 END) AS BIGINT) AS depth_rev
FROM v_base GROUP BY 1, 2 HAVING COUNT(*) >= 3 AND SUM(CASE WHEN strand = '-' THEN 1 ELSE 0 END) >= 1
  AND SUM(CASE WHEN strand = '+' THEN 1 ELSE 0 END) >= 1""")
def f_min_depth(v):
    return lookups.min_depth(v.base, 3, 1)


@question("f_max_identical", "v_read", """
SELECT read_id, chrom, start_pos, strand FROM (SELECT *, row_number() OVER (PARTITION BY chrom, strand, mapq, start_pos // 500 ORDER BY read_id) AS rn
FROM v_read) WHERE rn <= 2""")
def f_max_identical(v):
    d = v.read.withColumn("cell", F.floor(F.col("start_pos") / 500))
    out = lookups.cap_identical(d, ["chrom", "strand", "mapq", "cell"], 2, "read_id")
    return out.select("read_id", "chrom", "start_pos", "strand")


@question("f_fixed_steps", "v_cytosine", "SELECT sample, chrom, chrom_pos FROM v_cytosine WHERE chrom_pos % 50 = 1")
def f_fixed_steps(v):
    return v.cytosine.filter(F.col("chrom_pos") % 50 == 1).select("sample", "chrom", "chrom_pos")


@question("f_quality_first_cycle", "v_base", "SELECT read_id, chrom, pos, base FROM v_base WHERE cycle = 1 AND qual >= 10")
def f_quality_first_cycle(v):
    return v.base.filter((F.col("cycle") == 1) & (F.col("qual") >= 10)).select("read_id", "chrom", "pos", "base")


_LEAD, _IN = "|".join(Q.ADAPTER_HEAD), "|".join(Q.ADAPTER_INSIDE)


@question("f_contaminant_class", "v_alignment", f"""
WITH r AS (SELECT read_id, CASE WHEN read_id % 11 = 0 THEN concat('ATCGGAAGAG', seq) WHEN read_id % 13 = 0 THEN concat(substring(seq, 1, 20), 'GATCGGAAGAG', seq)
  WHEN read_id % 17 = 0 THEN concat(repeat('A', 700), seq) ELSE seq END AS seq FROM v_alignment)
SELECT read_id, CASE WHEN regexp_matches(seq, '^({_LEAD})') THEN 'adapter' WHEN regexp_matches(seq, '({_IN})') THEN 'adapter_trim'
  WHEN (length(seq) - length(replace(seq, 'A', ''))) / CAST(length(seq) AS DOUBLE) > 0.9 THEN 'poly_a' ELSE 'clean' END AS class FROM r""")
def f_contaminant_class(v):
    seq = (F.when(F.col("read_id") % 11 == 0, F.concat(F.lit("ATCGGAAGAG"), "seq"))
           .when(F.col("read_id") % 13 == 0, F.concat(F.substring("seq", 1, 20), F.lit("GATCGGAAGAG"), "seq"))
           .when(F.col("read_id") % 17 == 0, F.concat(F.repeat(F.lit("A"), 700), "seq")).otherwise(F.col("seq")))
    r = v.alignment.select("read_id", seq.alias("seq"))
    return r.select("read_id", Q.contaminant_class(F.col("seq")).alias("class"))


@question("f_contains_cpg", "v_alignment", "SELECT read_id FROM v_alignment WHERE contains(ref, 'CG')")
def f_contains_cpg(v):
    return v.alignment.filter(F.col("ref").contains("CG")).select("read_id")


@question("f_chrom_whitelist", "v_feature", """
WITH z AS (SELECT chrom, MAX(end_pos) - 50 AS length FROM v_feature WHERE chrom <> 'chr5' GROUP BY 1)
SELECT f.feat_id, f.chrom FROM v_feature f JOIN z ON f.chrom = z.chrom WHERE f.start_pos >= 1 AND f.end_pos <= z.length""")
def f_chrom_whitelist(v):
    sizes = v.feature.filter(F.col("chrom") != "chr5").groupBy("chrom").agg((F.max("end_pos") - 50).alias("length"))
    f = v.feature.join(sizes, "chrom").filter((F.col("start_pos") >= 1) & (F.col("end_pos") <= F.col("length")))
    return f.select("feat_id", "chrom")


@question("p_frac_meth", "v_cytosine", """
SELECT sample, chrom, chrom_pos, ROUND(c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE), 6) AS frac_meth,
  ROUND((c_reads + c_reads_nonconv) / CAST(nullif(c_reads + c_reads_nonconv + t_reads, 0) AS DOUBLE), 6) AS frac_meth_all,
  ROUND((c_reads + c_reads_nonconv + t_reads) / CAST(nullif(c_reads + c_reads_nonconv + t_reads + ag_reads, 0) AS DOUBLE), 6) AS frac_ct
FROM v_cytosine""")
def p_frac_meth(v):
    r = lambda c, n: near(c, 6).alias(n)
    return v.cytosine.select("sample", "chrom", "chrom_pos", r(M.frac_meth(), "frac_meth"),
                             r(M.frac_meth(False), "frac_meth_all"), r(M.frac_c_or_t(), "frac_ct"))


@question("p_opp_a_two_ways", "v_cytosine", """
SELECT sample, chrom, chrom_pos, ROUND(a_reads_opp / CAST(nullif(total_reads_opp, 0) AS DOUBLE), 6) AS of_total,
  ROUND(a_reads_opp / CAST(nullif(a_reads_opp + total_reads_opp, 0) AS DOUBLE), 6) AS of_sum FROM v_cytosine""")
def p_opp_a(v):
    return v.cytosine.select("sample", "chrom", "chrom_pos", near(M.opp_a_of_total(), 6).alias("of_total"),
                             near(M.opp_a_of_sum(), 6).alias("of_sum"))


@question("p_context_call", "v_base", """
WITH y AS (SELECT chrom, pos, strand, ref_base, lead(base) OVER w AS after, lag(base) OVER w AS before, next_ref, prev_ref FROM v_base WINDOW w AS (PARTITION BY read_id ORDER BY off)),
z AS (SELECT chrom, pos, CASE strand WHEN '+' THEN next_ref ELSE translate(prev_ref, 'ACGT', 'TGCA') END AS next_ref, CASE strand WHEN '+' THEN after ELSE translate(before, 'ACGT', 'TGCA') END AS next_base
  FROM y WHERE ref_base = CASE strand WHEN '+' THEN 'C' ELSE 'G' END),
k AS (SELECT chrom, pos, next_ref, next_base, COUNT(*) AS n FROM z WHERE next_base IS NOT NULL GROUP BY 1, 2, 3, 4),
m AS (SELECT chrom, pos, max(CASE WHEN pos % 3 > 0 THEN next_ref END) AS ref,
  arg_max(next_base, n * 1000 - ascii(next_base)) AS maj, SUM(n) AS total FROM k GROUP BY 1, 2),
f AS (SELECT m.*, coalesce(ref, maj) AS call FROM m)
SELECT f.chrom, f.pos, CASE WHEN SUM(CASE WHEN k.next_base = f.call OR (f.call = 'C' AND k.next_base = 'T') THEN k.n ELSE 0 END) / CAST(max(total) AS DOUBLE) >= 0.899
  THEN max(f.call) ELSE 'N' END AS next_call
FROM f JOIN k ON f.chrom = k.chrom AND f.pos = k.pos GROUP BY f.chrom, f.pos""")
def p_context_call(v):
    # the base after each cytosine comes from the read string itself, no window over reads
    a = R.orient(v.alignment)
    i = F.filter(F.sequence(F.lit(1), F.length("seq") - 1), lambda i: F.substring(F.col("o_ref"), i, F.lit(1)) == "C")
    rows = a.select("chrom", "start_pos", "o_strand", "o_ref", "o_seq", F.explode(i).alias("i"))
    at = lambda c: F.substring(F.col(c), F.col("i") + 1, F.lit(1))
    pos = F.when(F.col("o_strand") == "+", F.col("start_pos") + F.col("i") - 1).otherwise(F.col("start_pos") + F.length("o_seq") - F.col("i"))
    rows = rows.select("chrom", pos.alias("pos"), at("o_ref").alias("nr"), at("o_seq").alias("nb"))
    n = {b: F.sum((F.col("nb") == b).cast("bigint")) for b in "ACGT"}
    g = rows.groupBy("chrom", "pos").agg(F.max(F.when(F.col("pos") % 3 > 0, F.col("nr"))).alias("ref"), *[c.alias(f"n_{b}") for b, c in n.items()])
    counts = F.array(*[F.struct(F.col(f"n_{b}").alias("n"), (-F.ascii(F.lit(b))).alias("o"), F.lit(b).alias("b")) for b in "ACGT"])
    g = g.withColumn("maj", F.array_max(counts)["b"])
    call = F.coalesce("ref", "maj")
    hit = sum(F.when((call == b) | ((call == "C") & F.lit(b == "T")), F.col(f"n_{b}")).otherwise(0) for b in "ACGT")
    total = sum(F.col(f"n_{b}") for b in "ACGT")
    return g.select("chrom", "pos", M.context_call(F.col("ref"), F.col("maj"), hit / total).alias("next_call"))


@question("p_iupac_match", "v_alignment", f"""
SELECT read_id, CASE WHEN regexp_matches(ref, '{Q.iupac_regex("GCH")}') THEN 1 ELSE 0 END AS gch,
  CASE WHEN regexp_matches(ref, '{Q.iupac_regex("HCG")}') THEN 1 ELSE 0 END AS hcg,
  CASE WHEN regexp_matches(ref, '{Q.iupac_regex("WCGW")}') THEN 1 ELSE 0 END AS wcgw,
  CASE WHEN regexp_matches(ref, '{Q.iupac_regex("RYNU")}') THEN 1 ELSE 0 END AS rynu FROM v_alignment""")
def p_iupac_match(v):
    return v.alignment.select("read_id", *[F.col("ref").rlike(Q.iupac_regex(p)).cast("int").alias(p.lower()) for p in ("GCH", "HCG", "WCGW", "RYNU")])


@question("p_cytosine_class", "v_base", """
SELECT read_id, off, coalesce(next_ref = 'G', false) AS cpg, coalesce(prev_ref = 'G', false) AND coalesce(next_ref <> 'G', true) AS gch,
  coalesce(prev_ref = 'G', false) AND coalesce(next_ref = 'G', false) AS gcg, coalesce(prev_ref <> 'G', false) AND coalesce(next_ref = 'G', false) AS hcg,
  coalesce(prev_ref <> 'G', false) AND coalesce(next_ref <> 'G', true) AS hch FROM v_base WHERE ref_base = 'C'""")
def p_cytosine_class(v):
    cls = Q.cytosine_classes(F.col("prev_ref"), F.col("ref_base"), F.col("next_ref"))
    return v.base.filter(F.col("ref_base") == "C").select("read_id", "off", *[c.alias(n) for n, c in cls.items()])


@question("p_revcomp", "v_seq", """
SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, lower(seq) AS toggled FROM v_seq""")
def p_revcomp(v):
    return v.seq.select("seq_id", Q.revcomp(F.col("seq")).alias("rc"), Q.toggle_case(F.col("seq")).alias("toggled"))


@question("p_bisulfite_convert", "v_seq", """
SELECT seq_id, translate(replace(seq, 'CG', 'YG'), 'C', 'T') AS fw, translate(replace(seq, 'CG', 'CR'), 'G', 'A') AS rev, translate(seq, 'C', 'T') AS plain FROM v_seq""")
def p_bisulfite_convert(v):
    s = F.col("seq")
    return v.seq.select("seq_id", Q.bisulfite_convert(s).alias("fw"), Q.bisulfite_convert(s, True).alias("rev"),
                        Q.bisulfite_convert(s, keep_cpg=False).alias("plain"))


@question("p_quality_scale", "v_alignment", """
SELECT chrom, CAST(MIN(ascii(substring(qual, 1, 1))) AS INT) AS lowest, CASE WHEN MIN(ascii(substring(qual, 1, 1))) < 64 THEN 33 ELSE 64 END AS scale
FROM v_alignment GROUP BY 1""")
def p_quality_scale(v):
    low = F.min(F.ascii(F.substring("qual", 1, 1)))
    return v.alignment.groupBy("chrom").agg(low.alias("lowest"), F.when(low < 64, 33).otherwise(64).alias("scale"))


@question("p_meth_colour", "v_cytosine", f"""
WITH k AS (SELECT sample, chrom, chrom_pos, {FM} AS f FROM v_cytosine), d AS (SELECT *, FLOOR(10.0 * abs(f - 0.5) * 2.0) AS d FROM k)
SELECT sample, chrom, chrom_pos, CASE WHEN f IS NULL THEN '255,255,204' WHEN d = 0 THEN '153,153,153'
  WHEN f > 0.5 THEN CASE WHEN d <= 3 THEN '255,153,153' WHEN d <= 7 THEN '255,102,102' ELSE '255,0,0' END
  ELSE CASE WHEN d <= 3 THEN '153,255,153' WHEN d <= 7 THEN '102,255,102' ELSE '0,255,0' END END AS colour FROM d""")
def p_meth_colour(v):
    return v.cytosine.select("sample", "chrom", "chrom_pos", M.meth_colour(M.frac_meth()).alias("colour"))


@question("p_feature_anchor", "v_feature", """
WITH a AS (SELECT *, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS tss, CASE WHEN strand = '-' THEN start_pos ELSE end_pos END AS tes,
  (start_pos + end_pos + 1) // 2 AS mid FROM v_feature)
SELECT feat_id, tss, tes, CAST(mid AS INT) AS mid, CASE WHEN strand = '-' THEN greatest(start_pos, tss - 10) ELSE tss - 10 END AS low,
  CASE WHEN strand = '-' THEN tss + 10 ELSE least(end_pos, tss + 10) END AS high FROM a""")
def p_feature_anchor(v):
    s, e, st = F.col("start_pos"), F.col("end_pos"), F.col("strand")
    low, high = I.flank_bounds(s, e, st, 10, "start", censor=True)
    return v.feature.select("feat_id", I.anchor(s, e, st, "start").alias("tss"), I.anchor(s, e, st, "end").alias("tes"),
                            I.anchor(s, e, st).alias("mid"), low.alias("low"), high.alias("high"))


@question("p_relative_region", "v_feature", """
WITH m AS (SELECT *, CAST((start_pos + end_pos) // 2 AS INT) AS mid FROM v_feature)
SELECT feat_id, CASE WHEN strand = '-' THEN mid - 200 ELSE mid - 500 END AS rel_start, CASE WHEN strand = '-' THEN mid + 500 ELSE mid + 200 END AS rel_end FROM m""")
def p_relative_region(v):
    a, b = I.relative_region(F.col("start_pos"), F.col("end_pos"), F.col("strand"), -500, 200)
    return v.feature.select("feat_id", a.alias("rel_start"), b.alias("rel_end"))


@question("p_domain_edges", "v_feature", """
SELECT feat_id, start_pos AS point, '+' AS edge_strand FROM v_feature WHERE strand <> '-'
UNION ALL SELECT feat_id, end_pos, '-' FROM v_feature WHERE strand <> '+'""")
def p_domain_edges(v):
    edge = lambda p, s: F.struct(F.col(p).alias("point"), F.lit(s).alias("edge_strand"))
    rows = v.feature.select("feat_id", "strand", F.explode(F.array(edge("start_pos", "+"), edge("end_pos", "-"))).alias("x"))
    rows = rows.filter((F.col("strand") == ".") | (F.col("strand") == F.col("x.edge_strand")))
    return rows.select("feat_id", "x.point", "x.edge_strand")


@question("p_frac_overlap", "v_feature", """
WITH s AS (SELECT *, start_pos + feat_id % 9 AS s2, end_pos + 9 + feat_id % 23 AS e2 FROM v_feature),
o AS (SELECT *, greatest(0, least(end_pos, e2) - greatest(start_pos, s2) + 1) AS ov, end_pos - start_pos + 1 AS a, e2 - s2 + 1 AS b FROM s)
SELECT feat_id, ROUND(ov / CAST(a AS DOUBLE), 6) AS of_first, ROUND(ov / CAST(a + b - ov AS DOUBLE), 6) AS of_union,
  ROUND(ov / CAST(least(a, b) AS DOUBLE), 6) AS of_smaller, ROUND(ov / CAST(greatest(a, b) AS DOUBLE), 6) AS of_larger FROM o""")
def p_frac_overlap(v):
    s, e = F.col("start_pos"), F.col("end_pos")
    s2, e2 = s + F.col("feat_id") % 9, e + 9 + F.col("feat_id") % 23
    return v.feature.select("feat_id", *[near(I.frac_overlap(s, e, s2, e2, d), 6).alias(f"of_{d}") for d in ("first", "union", "smaller", "larger")])


def _sizes(v):
    return v.cytosine.groupBy("chrom").agg(F.max("chrom_pos").cast("bigint").alias("length"))


@question("p_global_coord", "v_cytosine", """
WITH z AS (SELECT chrom, CAST(MAX(chrom_pos) AS BIGINT) AS length FROM v_cytosine GROUP BY 1),
o AS (SELECT chrom, coalesce(SUM(length) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM z)
SELECT sample, chrom, CAST(chrom_pos AS BIGINT) AS pos, CAST(offs + chrom_pos AS BIGINT) AS global_pos FROM v_cytosine JOIN o USING (chrom)""")
def p_global_coord(v):
    sizes = _sizes(v)
    g = lookups.to_global(v.cytosine.select("sample", "chrom", "chrom_pos"), sizes, "chrom_pos")
    return lookups.to_local(g.select("sample", "global_pos"), sizes)


@question("p_chrom_order", "v_feature", """
WITH c AS (SELECT DISTINCT CASE chrom WHEN 'chr4' THEN 'chrX' WHEN 'chr5' THEN 'chrM' ELSE chrom END AS chrom FROM v_feature)
SELECT chrom, CASE chrom WHEN 'chrX' THEN 23 WHEN 'chrM' THEN 25 ELSE CAST(replace(chrom, 'chr', '') AS INT) END AS number, chrom AS again FROM c""")
def p_chrom_order(v):
    c = F.when(F.col("chrom") == "chr4", "chrX").when(F.col("chrom") == "chr5", "chrM").otherwise(F.col("chrom"))
    d = v.feature.select(c.alias("chrom")).distinct()
    n = I.chrom_number(F.col("chrom"))
    return d.select("chrom", n.alias("number"), I.chrom_name(n).alias("again"))


@question("p_sample_order", "v_cytosine", """
WITH s AS (SELECT sample, chrom, chrom_pos, unnest(['a', 'b', 'c', 'd']) AS id, unnest([c_reads, t_reads, ag_reads + 2, total_reads_opp + 1]) AS val FROM v_cytosine),
o AS (SELECT *, lag(val) OVER w AS prev FROM s WINDOW w AS (PARTITION BY sample, chrom, chrom_pos ORDER BY val DESC, id)),
g AS (SELECT *, SUM(CASE WHEN prev IS NULL OR val + 2 >= prev THEN 0 ELSE 1 END) OVER (PARTITION BY sample, chrom, chrom_pos ORDER BY val DESC, id) AS grp FROM o),
j AS (SELECT sample, chrom, chrom_pos, grp, string_agg(id, '' ORDER BY id) AS tied FROM g GROUP BY 1, 2, 3, 4)
SELECT sample, chrom, chrom_pos, string_agg(tied, '>' ORDER BY grp) AS code FROM j GROUP BY 1, 2, 3""")
def p_sample_order(v):
    vals = {"a": F.col("c_reads"), "b": F.col("t_reads"), "c": F.col("ag_reads") + 2, "d": F.col("total_reads_opp") + 1}
    return v.cytosine.select("sample", "chrom", "chrom_pos", lookups.sample_order_code(vals, 2).alias("code"))


@question("p_barcode_hamming", "v_alignment", """
WITH r AS (SELECT read_id, seq, translate(qual, 'I5?+', 'hTgR') AS qual FROM v_alignment),
b AS (SELECT read_id, seq, substring(seq, 1, 3) AS code, bc, ord, hamming(substring(seq, 1, 3), bc) AS h,
  CAST(ascii(substring(qual,1,1)) >= 89 AS INT) + CAST(ascii(substring(qual,2,1)) >= 89 AS INT) + CAST(ascii(substring(qual,3,1)) >= 89 AS INT) AS p,
  CAST(ascii(substring(qual,1,1)) >= 89 AS INT) + CAST(ascii(substring(qual,2,1)) >= 89 AS INT) + CAST(ascii(substring(qual,3,1)) >= 89 AS INT) AS s
  FROM r, (VALUES ('ACG', 1), ('CAT', 2), ('GTA', 3), ('TGC', 4)) AS t(bc, ord)),
c AS (SELECT *, (h = 0 AND p = 3) OR (h = 1 AND s >= 2) AS clean FROM b)
SELECT read_id, code, coalesce(arg_max(CASE WHEN clean THEN bc ELSE 'lowQual_barcodes' END, ord) FILTER (WHERE h <= 1), 'unknown_barcodes') AS bin,
  CASE WHEN bool_or(clean) THEN substring(max(seq), 6) ELSE max(seq) END AS seq_out FROM c GROUP BY read_id, code""")
def p_barcode_hamming(v):
    r = v.alignment.select("read_id", "seq", F.translate("qual", "I5?+", "hTgR").alias("qual"))
    return lookups.barcode_split(r).select("read_id", "code", "bin", "seq_out")
