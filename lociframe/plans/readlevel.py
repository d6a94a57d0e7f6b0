"""Reads, read bases and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import sequence as Q
from lociframe.operators import readlevel as R
from lociframe.operators import sequences as S
from lociframe.plans.aggregates import rounded
from lociframe.plans.registry import question

# read-direction strings and their positions, row by row
ORIENT = """o AS (SELECT read_id, chrom, start_pos, strand, mapq, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS s,
  CASE WHEN strand = '-' THEN reverse(translate(ref, 'ACGT', 'TGCA')) ELSE ref END AS r FROM v_alignment),
b AS (SELECT *, unnest(generate_series(1, 59)) AS i FROM o),
k AS (SELECT read_id, chrom, strand, mapq, i, CASE WHEN strand = '+' THEN start_pos + i - 1 ELSE start_pos + 60 - i END AS pos, substring(s, i, 1) AS sb, substring(r, i, 1) AS rb,
  substring(r, i + 1, 1) AS rn, substring(s, i + 1, 1) AS sn, CASE WHEN i > 1 THEN substring(r, i - 1, 1) END AS rp, CASE WHEN i < 59 THEN substring(r, i + 2, 1) END AS rn2 FROM b),
z AS (SELECT *, rb = 'C' AND sb IN ('C', 'T') AS isc FROM k),
q AS (SELECT *, SUM(CASE WHEN isc AND sb = 'T' AND rn <> 'G' THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i) < 1 AS zone FROM z)"""


@question("a_reads_to_cytosines", "v_alignment", f"""
WITH {ORIENT}, own AS (SELECT chrom, pos, strand, CAST(sb = 'C' AND NOT zone AS INT) AS c, CAST(sb = 'C' AND zone AS INT) AS cn, CAST(sb = 'T' AS INT) AS t, CAST(sn = 'G' AS INT) AS ng, 1 AS nt, 0 AS ot, 0 AS oa
  FROM q WHERE isc AND rn = 'G' AND mapq >= 5),
opp AS (SELECT chrom, pos, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS strand, 0 AS c, 0 AS cn, 0 AS t, 0 AS ng, 0 AS nt, 1 AS ot, CAST(sb = 'A' AS INT) AS oa FROM q WHERE rb = 'G' AND rp = 'C' AND mapq >= 5)
SELECT chrom, pos AS chrom_pos, strand, CAST(SUM(c) AS BIGINT) AS c_reads, CAST(SUM(cn) AS BIGINT) AS c_reads_nonconv, CAST(SUM(t) AS BIGINT) AS t_reads, CAST(SUM(ng) AS BIGINT) AS next_base_g,
  CAST(SUM(nt) AS BIGINT) AS next_base_total, CAST(SUM(ot) AS BIGINT) AS total_reads_opp, CAST(SUM(oa) AS BIGINT) AS a_reads_opp FROM (SELECT * FROM own UNION ALL SELECT * FROM opp) GROUP BY 1, 2, 3""")
def reads_to_cytosines(v):
    return R.count_cytosines(v.alignment, min_mapq=5)


@question("a_methylread_table", "v_alignment", f"WITH {ORIENT} SELECT read_id, chrom, pos AS chrom_pos, strand, sb AS base, zone AS in_zone FROM q WHERE isc AND rn = 'G'")
def methylread_table(v):
    return R.cytosine_calls(v.alignment).filter(F.col("next_ref") == "G").select("read_id", "chrom", "chrom_pos", "strand", "base", "in_zone")


@question("a_conversion_by_cycle", "v_alignment", f"""
WITH {ORIENT} SELECT CASE WHEN rn = 'G' THEN 'CG' ELSE 'CH' END AS context, CAST(i AS INT) AS cycle, zone AS in_zone, sb = 'T' AS converted, COUNT(*) AS n FROM q WHERE isc GROUP BY 1, 2, 3, 4""")
def conversion_by_cycle(v):
    return R.conversion_by_cycle(R.cytosine_calls(v.alignment))


@question("a_type_methylation", "v_alignment", f"""
WITH {ORIENT}, p AS (SELECT chrom, pos, strand, CASE WHEN rn = 'G' THEN 'CG' WHEN rn2 IS NULL THEN 'C' WHEN rn2 = 'G' THEN 'CHG' ELSE 'CHH' END AS type, COUNT(*) AS n, SUM(CAST(sb = 'C' AS INT)) AS c FROM q WHERE isc AND NOT zone GROUP BY 1, 2, 3, 4)
SELECT type, COUNT(*) AS n_positions, CAST(SUM(n) AS BIGINT) AS n_reads, CAST(SUM(c) AS BIGINT) AS n_c, ROUND(avg(c / CAST(n AS DOUBLE)), 6) AS mean_meth FROM p GROUP BY 1""")
def type_methylation(v):
    return rounded(R.type_methylation(R.cytosine_calls(v.alignment)), "mean_meth")


@question("a_mismatch_by_cycle", "v_base", "SELECT ref_base, base, CAST(cycle AS BIGINT) AS cycle, COUNT(*) AS n FROM v_base WHERE ref_base <> base GROUP BY 1, 2, 3")
def mismatch_by_cycle(v):
    return R.mismatch_by_cycle(v.base)


@question("a_snp_context", "v_base", """
SELECT concat(coalesce(prev_ref, '0'), '/', ref_base, '/', coalesce(next_ref, '0'), ' -> ', base, strand) AS key, COUNT(*) AS n FROM v_base GROUP BY 1""")
def snp_context(v):
    return R.snp_context(v.base)


@question("a_base_composition", "v_base", "SELECT base, strand, cycle, qual, COUNT(*) AS n FROM v_base GROUP BY 1, 2, 3, 4")
def base_composition(v):
    return R.base_composition(v.base, ["base", "strand", "cycle", "qual"])


@question("a_composition_strata", "v_base", """
SELECT strand, CASE WHEN cycle <= 20 THEN 'low' WHEN cycle <= 40 THEN 'medium' ELSE 'high' END AS stratum, COUNT(*) FILTER (WHERE base = 'A') AS "n_A", COUNT(*) FILTER (WHERE base = 'C') AS "n_C",
  COUNT(*) FILTER (WHERE base = 'G') AS "n_G", COUNT(*) FILTER (WHERE base = 'T') AS "n_T", ROUND(COUNT(*) FILTER (WHERE base = 'T') / CAST(COUNT(*) FILTER (WHERE base IN ('C', 'T')) AS DOUBLE), 6) AS converted FROM v_base GROUP BY 1, 2""")
def composition_strata(v):
    return rounded(R.composition_by_stratum(v.base, 20, 40), "converted")


@question("a_snp_evidence", "v_base", """
SELECT chrom, pos, COUNT(*) FILTER (WHERE base IN ('G', 'A') OR (base = 'T' AND strand = '-')) AS n_snp, COUNT(*) FILTER (WHERE base = 'C') AS n_cytosine,
  ROUND(COUNT(*) FILTER (WHERE base IN ('G', 'A') OR (base = 'T' AND strand = '-')) / CAST(nullif(COUNT(*) FILTER (WHERE base IN ('G', 'A', 'C') OR (base = 'T' AND strand = '-')), 0) AS DOUBLE), 6) AS share
FROM v_base WHERE ref_base = 'C' GROUP BY 1, 2""")
def snp_evidence(v):
    return rounded(R.snp_evidence(v.base), "share")


@question("a_quality_covariates", "v_base", """
WITH w AS (SELECT qual, cycle, CASE WHEN ref_base = 'C' AND base = 'T' AND qual > 5 THEN 1 ELSE 2 END AS o, CASE WHEN ref_base = 'C' AND base = 'T' THEN CASE WHEN qual <= 5 THEN 1 ELSE 0 END WHEN base = ref_base THEN 0 ELSE 2 END AS m FROM v_base)
SELECT qual, cycle, CAST(SUM(o) AS BIGINT) AS observations, CAST(SUM(m) AS BIGINT) AS mismatches, CAST(least(40, FLOOR(-10 * log10((SUM(m) + 1) / CAST(SUM(o) + 1 AS DOUBLE)) + 0.5)) AS BIGINT) AS empirical_quality FROM w GROUP BY 1, 2""")
def quality_covariates(v):
    return R.quality_covariates(v.base)


@question("a_lane_metrics", "v_read", """
WITH s AS (SELECT read_id % 8 AS lane, chrom, start_pos, strand, COUNT(*) AS n, COUNT(*) FILTER (WHERE mapq >= 1) AS m FROM v_read GROUP BY 1, 2, 3, 4)
SELECT lane, CAST(SUM(n) AS BIGINT) AS n_reads, CAST(SUM(m) AS BIGINT) AS n_mapped, COUNT(*) FILTER (WHERE m > 0) AS n_unique_starts FROM s GROUP BY 1""")
def lane_metrics(v):
    return R.lane_metrics(v.read.withColumn("lane", F.col("read_id") % 8), "lane")


CYCLES = range(1, 61)


@question("a_quality_matrix", "v_base", f"""
SELECT read_id, {", ".join(f"max(qual) FILTER (WHERE cycle = {c}) AS c{c}" for c in CYCLES)} FROM v_base GROUP BY 1""")
def quality_matrix(v):
    return R.base_matrix(v.base, "qual", CYCLES)


@question("a_adapter_trim", "v_alignment", """
WITH r AS (SELECT CASE WHEN read_id % 3 = 0 THEN concat(substring(seq, 1, CAST(read_id % 41 AS INT)), 'GATCGGAAGAG') ELSE seq END AS s FROM v_alignment)
SELECT instr(s, 'GATCGGAAGAG') - 1 AS trim_length, COUNT(*) AS n FROM r WHERE instr(s, 'GATCGGAAGAG') > 0 GROUP BY 1""")
def adapter_trim(v):
    s = F.when(F.col("read_id") % 3 == 0, F.concat(F.substring(F.col("seq"), F.lit(1), (F.col("read_id") % 41).cast("int")), F.lit("GATCGGAAGAG"))).otherwise(F.col("seq"))
    d = v.alignment.select(s.alias("s")).filter(F.col("s").contains("GATCGGAAGAG"))
    return d.groupBy(Q.adapter_trim_length(F.col("s")).cast("bigint").alias("trim_length")).agg(F.count(F.lit(1)).alias("n"))


WORDS = "w AS (SELECT seq_id, i, substring(seq, CAST(i AS INT), {n}) AS word FROM (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - {n} + 1)) AS i FROM v_seq WHERE length(seq) >= {n}))"


@question("a_nmer_counts", "v_seq", f"WITH {WORDS.format(n=4)} SELECT word, COUNT(*) AS n FROM w GROUP BY 1")
def nmer_counts(v):
    return S.nmer_counts(v.seq, 4)


@question("a_nmer_both_strands", "v_seq", f"""
WITH {WORDS.format(n=3)}, u AS (SELECT word FROM w UNION ALL SELECT reverse(translate(word, 'ACGT', 'TGCA')) FROM w), c AS (SELECT word, COUNT(*) AS n FROM u GROUP BY 1), l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b)
SELECT concat(x.b, y.b, z.b) AS word, coalesce(n, 0) AS n FROM l x, l y, l z LEFT JOIN c ON c.word = concat(x.b, y.b, z.b)""")
def nmer_both_strands(v):
    return S.nmer_counts(v.seq, 3, both_strands=True, all_permutations=True)


@question("a_nmer_start", "v_seq", "SELECT substring(seq, 5, 3) AS word, COUNT(*) AS n FROM v_seq WHERE length(seq) >= 7 GROUP BY 1")
def nmer_start(v):
    return S.nmer_counts(v.seq, 3, start=5)


@question("a_nmer_enrichment", "v_seq", f"""
WITH {WORDS.format(n=3)}, c AS (SELECT word, COUNT(*) AS n FROM w GROUP BY 1), f AS (SELECT b, SUM(length(seq) - length(replace(seq, b, ''))) / CAST(SUM(length(seq)) AS DOUBLE) AS f FROM v_seq, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) GROUP BY 1)
SELECT word, n, ROUND(n / CAST((SELECT SUM(n) FROM c) AS DOUBLE), 6) AS share, ROUND(a.f * b.f * d.f, 6) AS expected, ROUND(n / CAST((SELECT SUM(n) FROM c) AS DOUBLE) / (a.f * b.f * d.f), 5) AS enrichment
FROM c JOIN f a ON a.b = substring(word, 1, 1) JOIN f b ON b.b = substring(word, 2, 1) JOIN f d ON d.b = substring(word, 3, 1)""")
def nmer_enrichment(v):
    return rounded(rounded(S.nmer_enrichment(v.seq, 3), "share", "expected"), "enrichment", digits=5)


@question("k_top_nmers", "v_seq", f"WITH {WORDS.format(n=5)} SELECT word, COUNT(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def top_nmers(v):
    return S.nmer_counts(v.seq, 5).orderBy(F.desc("n"), "word").limit(20)


@question("a_nmer_windows", "v_seq", f"WITH {WORDS.format(n=2)} SELECT seq_id, CAST((i - 1) // 200 * 200 + 1 AS BIGINT) AS \"window\", word, COUNT(*) AS n FROM w GROUP BY 1, 2, 3")
def nmer_windows(v):
    return S.nmer_windows(v.seq, 2, 200)


@question("a_pattern_positions", "v_alignment", """
WITH w AS (SELECT i, substring(seq, i, 3) AS word FROM (SELECT seq, unnest(generate_series(1, 58)) AS i FROM v_alignment))
SELECT CAST(i AS INT) AS pos, 'TGA' AS pattern, COUNT(*) AS n FROM w WHERE word = 'TGA' GROUP BY 1 UNION ALL SELECT CAST(i AS INT), 'YGR', COUNT(*) FROM w WHERE regexp_matches(word, '^[CT]G[AG]$') GROUP BY 1""")
def pattern_positions(v):
    return S.pattern_position_counts(v.alignment.select(F.col("read_id").alias("seq_id"), "seq"), ["TGA", "YGR"])


@question("w_motif_positions", "v_seq", f"""
WITH {WORDS.format(n=3)} SELECT seq_id, CAST(i AS INT) AS pos, '+' AS strand FROM w WHERE regexp_matches(word, '^GC[ACT]$') UNION ALL SELECT seq_id, CAST(i AS INT), '-' FROM w WHERE regexp_matches(word, '^[AGT]GC$')""")
def motif_positions(v):
    return S.motif_positions(v.seq, "GCH")


@question("w_cpg_coords", "v_seq", f"WITH {WORDS.format(n=2)} SELECT seq_id, CAST(i AS INT) AS pos FROM w WHERE word = 'CG'")
def cpg_coords(v):
    return S.cpg_coords(v.seq)


@question("w_oligo_runs", "v_seq", """
WITH b AS (SELECT seq_id, length(seq) AS len, '+' AS strand, seq AS s FROM v_seq UNION ALL SELECT seq_id, length(seq), '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM v_seq),
p AS (SELECT seq_id, len, strand, string_split(regexp_replace(s, '((?:CA)+)', '<\\1>', 'g'), '<') AS parts FROM b),
x AS (SELECT seq_id, len, strand, parts, unnest(generate_series(2, len(parts))) AS k FROM p),
y AS (SELECT seq_id, len, strand, list_sum(list_transform(parts[1:k - 1], lambda a: length(replace(a, '>', '')))) AS ofs, length(string_split(parts[k], '>')[1]) AS size FROM x)
SELECT seq_id, strand, CAST(CASE WHEN strand = '+' THEN ofs ELSE len - ofs - size END AS INT) AS pos, CAST(size // 2 AS INT) AS copies FROM y WHERE size >= 4""")
def oligo_runs(v):
    return S.oligo_runs(v.seq, "CA", 2)


@question("w_homopolymers", "v_seq", """
WITH p AS (SELECT seq_id, string_split(regexp_replace(seq, '(A{3}|T{3})', '<\\1>', 'g'), '<') AS parts FROM v_seq), x AS (SELECT seq_id, parts, unnest(generate_series(2, len(parts))) AS k FROM p)
SELECT seq_id, CAST(1 + list_sum(list_transform(parts[1:k - 1], lambda a: length(replace(a, '>', '')))) AS INT) AS pos, CASE WHEN parts[k][1] = 'A' THEN '+' ELSE '-' END AS strand FROM x""")
def homopolymers(v):
    return S.homopolymers(v.seq, 3)


DENS = """d AS (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - 1)) AS m FROM v_seq WHERE length(seq) >= 2),
t AS (SELECT seq_id, m, substring(seq, CAST(greatest(m - 19, 0) AS INT) + 1, CAST(m + 21 - greatest(m - 19, 0) + 1 AS INT)) AS t FROM d WHERE m + 21 <= length(seq) - 1),
n AS (SELECT seq_id, m, length(t) - length(replace(t, 'C', '')) AS c, length(t) - length(replace(t, 'G', '')) AS g, (length(t) - length(replace(t, 'CG', ''))) // 2 AS cg FROM t)"""


@question("w_cpg_obs_exp", "v_seq", f"WITH {DENS} SELECT seq_id, m AS pos, ROUND(coalesce(cg * 40 / CAST(nullif(c * g, 0) AS DOUBLE), 0.0), 6) AS value FROM n")
def cpg_obs_exp(v):
    return rounded(S.base_density(v.seq, 40), "value").withColumn("pos", F.col("pos").cast("bigint"))


@question("w_gc_content", "v_seq", f"WITH {DENS} SELECT seq_id, m AS pos, ROUND((c + g) / 40.0, 6) AS value FROM n WHERE m % 10 = 0")
def gc_content(v):
    return rounded(S.base_density(v.seq, 40, "gc", 10), "value").withColumn("pos", F.col("pos").cast("bigint"))
