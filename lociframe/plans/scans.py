"""Scans, readers and writers over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import methylation as M
from lociframe.operators.piles import place
from lociframe.plans.registry import question
from lociframe.sources import cytosines, reads, tracks

FRAC = "ROUND(c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE), 6)"


@question("s_scan_cytosine", "v_cytosine", """
SELECT sample, chrom, chrom_pos, strand, c_reads, t_reads FROM v_cytosine
WHERE sample = 'A' AND chrom = 'chr2' AND chrom_pos BETWEEN 1000 AND 15000 AND c_reads + t_reads >= 3
  AND (total_reads_opp = 0 OR a_reads_opp / CAST(total_reads_opp AS DOUBLE) <= 0.101)""")
def scan_cytosine(v):
    out = cytosines.scan(v.cytosine, ["A"], [("chr2", 1000, 15000)], min_ct=3, max_opp_a=0.101)
    return out.select("sample", "chrom", "chrom_pos", "strand", "c_reads", "t_reads")


def call_columns():
    """Whether a read base is a cytosine call (reference C, or G on -), and its counts."""
    fwd = (F.col("strand") == "+") & (F.col("ref_base") == "C")
    rev = (F.col("strand") == "-") & (F.col("ref_base") == "G")
    meth = F.when(F.col("strand") == "+", F.col("base") == "C").otherwise(F.col("base") == "G")
    conv = F.when(F.col("strand") == "+", F.col("base") == "T").otherwise(F.col("base") == "A")
    one = lambda c: c.cast("bigint")
    return fwd | rev, {"c_reads": one(meth & (F.col("qual") >= 10)), "c_reads_nonconv": one(meth & (F.col("qual") < 10)),
                       "t_reads": one(conv), "ag_reads": one(~meth & ~conv)}


def read_cytosines(base):
    """Read-level cytosine calls of the base view: one row per read and reference C (or G on -)."""
    call, counts = call_columns()
    return base.filter(call).select(
        "read_id", *[c for c in ("chrom", "tile", "home") if c in base.columns], F.col("pos").alias("chrom_pos"), "strand", *[c.alias(n) for n, c in counts.items()])


READS_SQL = """SELECT read_id, chrom, pos AS chrom_pos, strand,
  CAST(CASE WHEN m AND qual >= 10 THEN 1 ELSE 0 END AS BIGINT) AS c_reads,
  CAST(CASE WHEN m AND qual < 10 THEN 1 ELSE 0 END AS BIGINT) AS c_reads_nonconv,
  CAST(CASE WHEN t THEN 1 ELSE 0 END AS BIGINT) AS t_reads,
  CAST(CASE WHEN NOT m AND NOT t THEN 1 ELSE 0 END AS BIGINT) AS ag_reads
FROM (SELECT *, CASE WHEN strand = '+' THEN base = 'C' ELSE base = 'G' END AS m,
             CASE WHEN strand = '+' THEN base = 'T' ELSE base = 'A' END AS t
      FROM v_base WHERE (strand = '+' AND ref_base = 'C') OR (strand = '-' AND ref_base = 'G'))"""


@question("s_reads_to_cpg", "v_base", f"""
WITH r AS ({READS_SQL})
SELECT chrom, chrom_pos, strand, COUNT(*) AS n_reads, CAST(SUM(c_reads) AS BIGINT) AS c_reads,
  CAST(SUM(c_reads_nonconv) AS BIGINT) AS c_reads_nonconv, CAST(SUM(t_reads) AS BIGINT) AS t_reads,
  CAST(SUM(ag_reads) AS BIGINT) AS ag_reads
FROM r GROUP BY 1, 2, 3""")
def reads_to_cpg(v):
    return cytosines.fold_reads(read_cytosines(v.base))


@question("s_scan_feature", "v_feature", """
SELECT feat_id, chrom, start_pos, end_pos, strand FROM v_feature
WHERE feat_type = '1-URGENT' AND chrom = 'chr3' AND start_pos <= 9000 AND end_pos >= 2000""")
def scan_feature(v):
    f = v.feature
    keep = (F.col("feat_type") == "1-URGENT") & (F.col("chrom") == "chr3") & (F.col("start_pos") <= 9000) & (F.col("end_pos") >= 2000)
    return f.filter(keep).select("feat_id", "chrom", "start_pos", "end_pos", "strand")


@question("s_bed_line", "v_cytosine", f"""
WITH m AS (SELECT *, c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE) AS f FROM v_cytosine),
k AS (SELECT *, CAST(FLOOR(10.0 * abs(f - 0.5) * 2.0) AS INT) AS d FROM m),
g AS (SELECT *, CASE WHEN d = 0 THEN '153,153,153' WHEN f > 0.5 THEN
    CASE WHEN d <= 3 THEN '255,153,153' WHEN d <= 7 THEN '255,102,102' ELSE '255,0,0' END
  ELSE CASE WHEN d <= 3 THEN '153,255,153' WHEN d <= 7 THEN '102,255,102' ELSE '0,255,0' END END AS colour FROM k)
SELECT sample, concat_ws(chr(9), chrom, CAST(chrom_pos AS VARCHAR), CAST(chrom_pos AS VARCHAR),
  concat('r', CAST(chrom_pos AS VARCHAR), strand), CAST(coalesce(CAST(FLOOR(100.0 * f + 0.5) AS BIGINT), 0) AS VARCHAR), strand,
  CAST(chrom_pos AS VARCHAR), CAST(chrom_pos AS VARCHAR), CASE WHEN f IS NULL THEN '255,255,204' ELSE colour END) AS line
FROM g""")
def bed_lines(v):
    p = F.col("chrom_pos")
    return v.cytosine.select("sample", tracks.bed_line(F.col("chrom"), p, p, F.col("strand"), M.frac_meth()).alias("line"))


@question("s_wig_lines", "v_cytosine", """
WITH m AS (SELECT concat(sample, '_', chrom) AS chrom, chrom_pos, c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE) AS f FROM v_cytosine)
SELECT chrom, CAST(chrom_pos AS BIGINT) AS ord, concat(CAST(chrom_pos AS VARCHAR), chr(9), CAST(CAST(FLOOR(100.0 * f + 0.5) AS BIGINT) AS VARCHAR)) AS value
FROM m WHERE f IS NOT NULL
UNION ALL SELECT DISTINCT chrom, CAST(-1 AS BIGINT), concat('variableStep chrom=', chrom) FROM m WHERE f IS NOT NULL""")
def wig_lines(v):
    d = v.cytosine.withColumn("f", M.frac_meth()).filter(F.col("f").isNotNull()).withColumn("chrom", F.concat_ws("_", "sample", "chrom"))
    return tracks.variable_step_lines(d, "chrom_pos", F.floor(F.lit(100.0) * F.col("f") + 0.5).cast("bigint"))


@question("s_bedgraph_lines", "v_feature", """
SELECT chrom, CAST(start_pos AS BIGINT) AS ord, concat_ws(chr(9), chrom, CAST(start_pos - 1 AS VARCHAR),
  CAST(end_pos AS VARCHAR), CAST(score AS VARCHAR)) AS value FROM v_feature""")
def bedgraph_lines(v):
    return tracks.bedgraph_lines(v.feature, "start_pos", "end_pos", F.col("score"))


def pileup_lines(base):
    """Pileup text rows gathered from the base view (depth per position is the read step bound)."""
    letter = F.when(F.col("base") == F.col("ref_base"), F.when(F.col("strand") == "+", ",").otherwise(".")).otherwise(
        F.when(F.col("strand") == "+", F.col("base")).otherwise(F.lower("base")))
    one = F.struct("read_id", letter.alias("b"), F.char(F.col("qual") + 33).alias("q"), F.col("cycle").cast("string").alias("c"))
    rows = base.groupBy(*place(base, "ref_base")).agg(F.sort_array(F.collect_list(one)).alias("r")).withColumnRenamed("ref_base", "ref")
    join = lambda f, sep: F.array_join(F.transform("r", lambda x: x[f]), sep)
    return rows.select("chrom", "pos", "ref", F.size("r").alias("depth"), F.concat(F.lit("@"), join("b", "")).alias("bases"),
                       F.concat(F.lit("@"), join("q", "")).alias("quals"), F.concat(join("c", ","), F.lit(",")).alias("cycles"))


@question("s_pileup_explode", "v_base", """
SELECT chrom, pos, ref_base AS ref, strand, base, CAST(qual AS BIGINT) AS qual, CAST(cycle AS BIGINT) AS cycle
FROM v_base WHERE qual >= 5""")
def pileup_explode(v):
    out = reads.explode_pileup(pileup_lines(v.tiled_bases()), min_quality=5)
    return out.select("chrom", "pos", "ref", "strand", "base", F.col("qual").cast("bigint").alias("qual"),
                      F.col("cycle").cast("bigint").alias("cycle"))


@question("s_emit_cytosines", "v_cytosine", """
SELECT sample, chrom, chrom_pos, next_base_ref FROM (SELECT *,
  CASE chrom_pos % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'A' WHEN 2 THEN 'C' ELSE 'T' END AS next_base_ref FROM v_cytosine)
WHERE next_base_ref = 'G' OR (c_reads + c_reads_nonconv + t_reads + ag_reads >= 10
  AND coalesce(c_reads / CAST(nullif(c_reads + t_reads, 0) AS DOUBLE), 1.0) >= 0.2)""")
def emit_cytosines(v):
    nxt = F.element_at(F.array(*map(F.lit, "GACT")), F.col("chrom_pos") % 4 + 1)
    d = v.cytosine.withColumn("next_base_ref", nxt)
    return d.filter(cytosines.emit_rule()).select("sample", "chrom", "chrom_pos", "next_base_ref")


@question("a_bismark_bed", "v_base", """
WITH c AS (SELECT chrom, pos, CASE WHEN base = ref_base THEN '+' ELSE '-' END AS state,
  CASE WHEN CASE strand WHEN '+' THEN next_ref = 'G' ELSE prev_ref = 'C' END THEN CASE WHEN base = ref_base THEN 'Z' ELSE 'z' END
       WHEN qual < 5 THEN 'Z' ELSE CASE WHEN base = ref_base THEN 'H' ELSE 'h' END END AS letter
  FROM v_base WHERE ref_base = CASE strand WHEN '+' THEN 'C' ELSE 'G' END),
g AS (SELECT chrom, pos, COUNT(*) AS n, SUM(CASE WHEN state = '+' THEN 1 ELSE 0 END) AS n_meth FROM c
  WHERE (state = '+' AND letter IN ('Z', 'X', 'H')) OR (state = '-' AND letter IN ('z', 'x', 'h')) GROUP BY 1, 2)
SELECT chrom, pos AS start_pos, pos + 1 AS end_pos, n_meth / CAST(n AS DOUBLE) AS meth FROM g
WHERE n >= 2 AND n_meth / CAST(n AS DOUBLE) >= 0.5""")
def bismark_bed(v):
    plus = F.col("strand") == "+"  # reads speak of the cytosines of their own strand
    b = v.base.filter(F.col("ref_base") == F.when(plus, "C").otherwise("G"))
    c = F.col("base") == F.col("ref_base")
    letter = F.when(F.when(plus, F.col("next_ref") == "G").otherwise(F.col("prev_ref") == "C"), F.when(c, "Z").otherwise("z")).when(F.col("qual") < 5, "Z").otherwise(
        F.when(c, "H").otherwise("h"))
    calls = b.select("chrom", "pos", F.when(c, "+").otherwise("-").alias("state"), letter.alias("letter"))
    return cytosines.bismark_positions(calls, 2, 0.5)


@question("s_tagalign", "v_alignment", """
SELECT chrom, start_pos, start_pos + length(seq) - 1 AS end_pos, seq, mapq, strand FROM v_alignment WHERE mapq >= 30""")
def tagalign(v):
    return tracks.tag_align(v.alignment, 30)


@question("s_tag_starts", "v_alignment", """
SELECT DISTINCT chrom, CASE WHEN strand = '-' THEN start_pos + length(seq) - 1 ELSE start_pos END AS read_start, strand
FROM v_alignment WHERE mapq >= 10""")
def tag_starts(v):
    return tracks.tag_starts(tracks.tag_align(v.alignment, 10))


@question("s_exon_breakup", "v_feature", """
WITH g AS (SELECT chrom, strand, feat_id, start_pos, unnest(generate_series(0, score % 4)) AS i FROM v_feature)
SELECT chrom, strand, feat_id, CAST(start_pos + i * 7 AS BIGINT) AS start_pos, CAST(start_pos + i * 7 + 3 AS BIGINT) AS end_pos FROM g""")
def exon_breakup(v):
    i = F.sequence(F.lit(0).cast("bigint"), F.col("score") % 4)
    text = lambda off: F.concat(F.array_join(F.transform(i, lambda k: (F.col("start_pos") + k * 7 + off).cast("string")), ","), F.lit(","))
    genes = v.feature.select("chrom", "strand", "feat_id", (F.col("score") % 4 + 1).cast("int").alias("n_exons"),
                             text(0).alias("starts"), text(3).alias("ends"))
    return tracks.exon_rows(genes, "starts", "ends")


@question("s_feature_points", "v_feature", """
WITH f AS (SELECT *, CAST(end_pos - start_pos + 1 AS BIGINT) AS feat_len FROM v_feature)
SELECT feat_type, chrom, feat_len, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS point, 'Starts' AS label, strand AS point_strand
FROM f WHERE feat_len <= 10
UNION ALL SELECT feat_type, chrom, feat_len, start_pos, CASE strand WHEN '.' THEN 'Unstranded' WHEN '-' THEN 'Ends' ELSE 'Starts' END, '+' FROM f WHERE feat_len > 10
UNION ALL SELECT feat_type, chrom, feat_len, end_pos, CASE strand WHEN '.' THEN 'Unstranded' WHEN '-' THEN 'Starts' ELSE 'Ends' END, '-' FROM f WHERE feat_len > 10""")
def feature_points(v):
    return tracks.feature_points(v.feature)
