"""Genotype questions over the read-base view."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import genotype as G
from lociframe.operators import sets as U
from lociframe.plans.registry import near, near_double, question
from lociframe.sources import converters as K


def rounded(df, *cols, digits):
    """Logs and ratios for comparison; there are up to ten for each position of the genome."""
    return df.withColumns({c: near_double(F.col(c), digits) for c in cols})


def _p(allele: str, m: str) -> str:
    plain = f"CASE WHEN base = '{allele}' THEN 1 - e ELSE e / 3.0 END"
    if allele not in "CG":
        return plain
    strand, product = ("+", "T") if allele == "C" else ("-", "A")
    kept, turned = f"((1 - {m}) * (1 - 0.9975) + {m})", f"((1 - {m}) * 0.9975)"
    return f"CASE WHEN strand = '{strand}' THEN CASE base WHEN '{allele}' THEN (1 - e) * {kept} WHEN '{product}' THEN e / 3.0 + {turned} ELSE e / 3.0 END ELSE {plain} END"


def like_sql(m: str = "CAST(0.5 AS DOUBLE)", src: str = "v_base") -> str:
    """Row-by-row likelihoods in long form: chrom, pos, ref_base, g, l."""
    ps = ", ".join(f"{_p(a, m)} AS p{a}" for a in "ACGT")
    sums = ", ".join(f"SUM(log10(0.5 * p{g[0]} + 0.5 * p{g[1]})) AS l_{g}" for g in G.GENOTYPES)
    return f"""eb AS (SELECT *, pow(CAST(10.0 AS DOUBLE), -qual / 10.0) AS e FROM {src}), pb AS (SELECT chrom, pos, ref_base, strand, {ps} FROM eb),
lk AS (SELECT chrom, pos, ref_base, COUNT(*) AS depth, {sums} FROM pb GROUP BY 1, 2, 3)"""


def prior_sql(g: str, ref: str = "ref_base") -> str:
    return f"CASE {ref} " + " ".join(f"WHEN '{r}' THEN log10(CAST({G.prior_value(r, g, 1e-3, 2.0)!r} AS DOUBLE))" for r in "ACGT") + " END"


def call_sql(src: str = "lk", name: str = "cl") -> str:
    rows = " UNION ALL ".join(f"SELECT chrom, pos, ref_base, depth, '{g}' AS g, {i} AS i, l_{g} + {prior_sql(g)} AS p FROM {src}" for i, g in enumerate(G.GENOTYPES))
    return f"""lg AS ({rows}), rk AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY p DESC, i) AS rn FROM lg),
{name} AS (SELECT chrom, pos, ref_base, max(depth) AS depth, max(g) FILTER (WHERE rn = 1) AS genotype, max(g) FILTER (WHERE rn = 2) AS runner_up,
  10.0 * (max(p) FILTER (WHERE rn = 1) - max(p) FILTER (WHERE rn = 2)) AS ratio FROM rk GROUP BY 1, 2, 3)"""


@question("g_likelihoods", "v_base", f"WITH {like_sql()} SELECT chrom, pos, depth, " + ", ".join(f'ROUND(l_{g}, 5) AS "{g}"' for g in G.GENOTYPES) + " FROM lk")
def likelihoods(v):
    return rounded(G.genotype_likelihoods(v.tiled_bases()), *G.GENOTYPES, digits=5).drop("ref_base", "tile")


@question("g_priors", "v_base", "WITH r AS (SELECT DISTINCT chrom, pos, ref_base FROM v_base) SELECT chrom, pos, " + ", ".join(f'ROUND({prior_sql(g)}, 6) AS "{g}"' for g in G.GENOTYPES) + " FROM r")
def priors(v):
    p = G.prior_columns(F.col("ref_base"))
    return v.base.select("chrom", "pos", "ref_base").distinct().select("chrom", "pos", *[near(c, 6).alias(g) for g, c in p.items()])


@question("g_calls", "v_base", f"WITH {like_sql()}, {call_sql()} SELECT chrom, pos, depth, genotype, ROUND(ratio, 4) AS ratio FROM cl")
def calls(v):
    out = G.call_genotypes(G.genotype_likelihoods(v.tiled_bases())).select("chrom", "pos", "depth", "genotype", "ratio")
    return rounded(out, "ratio", digits=4)


@question("g_confident_variants", "v_base", f"WITH {like_sql()}, {call_sql()} SELECT chrom, pos, genotype FROM cl WHERE ratio >= 0.0007 AND genotype <> concat(ref_base, ref_base)")
def confident_variants(v):
    return G.confident(G.call_genotypes(G.genotype_likelihoods(v.tiled_bases())), 0.0007, variants_only=True).select("chrom", "pos", "genotype")


TYPES_SQL = """hm AS (SELECT chrom, pos, CASE WHEN substring(genotype, 1, 1) = substring(genotype, 2, 1) THEN substring(genotype, 1, 1) ELSE 'N' END AS b FROM cl),
nw AS (SELECT *, max(b) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS m2,
  max(b) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS m1, max(b) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS p1,
  max(b) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) AS p2 FROM hm), nb AS (SELECT * FROM nw WHERE b IN ('C', 'G')),
ff AS (SELECT chrom, pos, CASE WHEN b = 'C' THEN '+' ELSE '-' END AS strand, CASE WHEN b = 'C' THEN p1 ELSE translate(m1, 'ACGT', 'TGCA') END AS f, CASE WHEN b = 'C' THEN p2 ELSE translate(m2, 'ACGT', 'TGCA') END AS s FROM nb),
ty AS (SELECT chrom, pos, strand, CASE WHEN f = 'G' THEN 'CG' WHEN f IS NULL OR s IS NULL THEN 'C' WHEN s = 'G' THEN 'CHG' ELSE 'CHH' END AS type FROM ff)"""


@question("g_cytosine_types", "v_base", f"WITH {like_sql()}, {call_sql()}, {TYPES_SQL} SELECT chrom, pos, strand, type FROM ty")
def cytosine_types(v):
    return G.cytosine_types(G.call_genotypes(G.genotype_likelihoods(v.tiled_bases(2))))


METH_SQL = """mt AS (SELECT b.chrom, b.pos, b.strand, t.type, SUM(CAST(CASE WHEN b.strand = '+' THEN base = 'C' ELSE base = 'G' END AS INT)) AS c, SUM(CAST(CASE WHEN b.strand = '+' THEN base = 'T' ELSE base = 'A' END AS INT)) AS t
  FROM v_base b JOIN ty t ON t.chrom = b.chrom AND t.pos = b.pos AND t.strand = b.strand GROUP BY 1, 2, 3, 4)"""


@question("g_called_methylation", "v_base", f"WITH {like_sql()}, {call_sql()}, {TYPES_SQL}, {METH_SQL} SELECT chrom, pos, strand, type, CAST(c AS BIGINT) AS c_reads, CAST(t AS BIGINT) AS t_reads FROM mt")
def called_methylation(v):
    b = v.tiled_bases(2)
    return G.called_methylation(b, G.cytosine_types(G.call_genotypes(G.genotype_likelihoods(b, counts=True))))


SECOND = like_sql("meth", "b2").replace("eb AS", "eb2 AS").replace("FROM eb)", "FROM eb2)").replace("pb AS", "pb2 AS").replace("FROM pb ", "FROM pb2 ").replace("lk AS", "lk2 AS")
SECOND_CALL = call_sql("lk2", "cl2").replace("lg AS", "lg2 AS").replace("FROM lg)", "FROM lg2)").replace("rk AS", "rk2 AS").replace("FROM rk ", "FROM rk2 ")


@question("g_two_pass", "v_base", f"""
WITH {like_sql()}, {call_sql()}, {TYPES_SQL}, {METH_SQL}, lv AS (SELECT type, SUM(c) / CAST(nullif(SUM(c) + SUM(t), 0) AS DOUBLE) AS meth FROM mt GROUP BY 1),
b2 AS (SELECT b.*, coalesce(l.meth, 0.5) AS meth FROM v_base b LEFT JOIN (SELECT chrom, pos, meth FROM ty JOIN lv USING (type)) l ON l.chrom = b.chrom AND l.pos = b.pos),
{SECOND}, {SECOND_CALL} SELECT chrom, pos, genotype, ROUND(ratio, 3) AS ratio FROM cl2""")
def two_pass(v):
    return rounded(G.genotype(v.base).select("chrom", "pos", "genotype", "ratio"), "ratio", digits=3)


def _by_strand() -> str:
    """Likelihoods in all and of the reads of either strand."""
    one = lambda g: f"log10(0.5 * p{g[0]} + 0.5 * p{g[1]})"
    sums = ", ".join(f"SUM({one(g)}) AS l_{g}, coalesce(SUM({one(g)}) FILTER (WHERE strand = '+'), 0) AS f_{g}, coalesce(SUM({one(g)}) FILTER (WHERE strand = '-'), 0) AS r_{g}" for g in G.GENOTYPES)
    return like_sql().split("lk AS")[0] + f"lk AS (SELECT chrom, pos, ref_base, COUNT(*) AS depth, {sums} FROM pb GROUP BY 1, 2, 3)"


# confident: ten times the logarithm of 30
BIAS = """ro AS (SELECT * FROM cl WHERE NOT (genotype = concat(ref_base, ref_base) AND ratio >= 14.7712)),
al AS (SELECT *, coalesce(""" + ", ".join(f"CASE WHEN substring({c}, {i}, 1) <> ref_base THEN substring({c}, {i}, 1) END" for c in ("genotype", "runner_up") for i in (1, 2)) + """) AS alt FROM ro),
po AS (""" + " UNION ALL ".join(f"SELECT chrom, pos, '{g}' AS g, l_{g} + {prior_sql(g)} AS a, f_{g} + {prior_sql(g)} AS f, r_{g} + {prior_sql(g)} AS r FROM lk" for g in G.GENOTYPES) + """),
pv AS (SELECT al.chrom, al.pos, al.ref_base, alt, genotype, """ + ", ".join(
    f"max({c}) FILTER (WHERE g = {name}) AS {c}_{kind}" for c in "afr" for kind, name in (("ref", "concat(al.ref_base, al.ref_base)"), ("mix", "concat(least(al.ref_base, alt), greatest(al.ref_base, alt))"), ("alt", "concat(alt, alt)"))) + """
  FROM al JOIN po ON po.chrom = al.chrom AND po.pos = al.pos WHERE alt IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
vr AS (SELECT *, """ + ", ".join(f"greatest({c}_mix, {c}_alt) + log10(1 + pow(10::DOUBLE, least({c}_mix, {c}_alt) - greatest({c}_mix, {c}_alt))) AS v_{c}" for c in "afr") + """ FROM pv)
SELECT chrom, pos, ref_base, alt, genotype, ROUND(10.0 * greatest(v_f + r_ref - v_a, v_r + f_ref - v_a), 4) AS strand_bias FROM vr"""


@question("g_strand_bias", "v_base", f"WITH {_by_strand()}, {call_sql()}, {BIAS}")
def strand_bias(v):
    return rounded(G.strand_bias(G.genotype_likelihoods(v.tiled_bases(), by_strand=True), confident_ratio=14.7712), "strand_bias", digits=4)


@question("g_downsample", "v_base", "SELECT chrom, pos, least(COUNT(*), 2) AS depth FROM v_base GROUP BY 1, 2")
def downsample(v):
    """Which reads stay follows the seed; the depth left at each position does not."""
    d = U.downsample_depth(v.tiled_bases(), 2, 3)
    return d.groupBy("chrom", "tile", "pos").agg(F.count(F.lit(1)).alias("depth")).drop("tile")


@question("s_vcf_lines", "v_base", f"""WITH {like_sql()}, {call_sql()},
al AS (SELECT *, ROUND(ratio, 2) AS q, coalesce({", ".join(f"CASE WHEN substring({c}, {i}, 1) <> ref_base THEN substring({c}, {i}, 1) END" for c in ("genotype", "runner_up") for i in (1, 2))}, '.') AS alt FROM cl WHERE genotype <> concat(ref_base, ref_base))
SELECT chrom, pos, concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), '.', ref_base, alt, printf('%.2f', q), CASE WHEN q >= 3 THEN 'PASS' ELSE 'LowQual' END, concat('DP=', CAST(depth AS VARCHAR)), 'GT',
  CASE WHEN substring(genotype, 1, 1) = substring(genotype, 2, 1) THEN '1/1' ELSE '0/1' END) AS line FROM al
UNION ALL SELECT NULL, unnest(range(-5, 0)), unnest(['##fileformat=VCFv4.1', '##FILTER=<ID=LowQual,Description="Quality below 3">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">',
  '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', array_to_string(['#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'SAMPLE'], chr(9))])""")
def vcf_lines(v):
    c = G.call_genotypes(G.genotype_likelihoods(v.tiled_bases())).filter(F.col("genotype") != F.concat("ref_base", "ref_base"))
    alt = G.alternate_allele(F.col("genotype"), F.col("runner_up"), F.col("ref_base"))
    gt = F.when(F.substring("genotype", 1, 1) == F.substring("genotype", 2, 1), "1/1").otherwise("0/1")
    return K.vcf_lines(c.select("chrom", "pos", F.col("ref_base").alias("ref"), alt.alias("alt"), near(F.col("ratio"), 2).alias("qual"), "depth", gt.alias("genotype")), 3.0)


@question("s_cpg_reads", "v_base", """
SELECT chrom, pos, read_id, strand, CASE WHEN (strand = '+' AND base = 'C') OR (strand = '-' AND base = 'G') THEN 'm' ELSE 'u' END AS call, qual FROM v_base
WHERE (strand = '+' AND ref_base = 'C' AND next_ref = 'G' AND base IN ('C', 'T')) OR (strand = '-' AND ref_base = 'G' AND prev_ref = 'C' AND base IN ('G', 'A'))""")
def cpg_reads(v):
    plus = (F.col("strand") == "+") & (F.col("ref_base") == "C") & (F.col("next_ref") == "G") & F.col("base").isin("C", "T")
    minus = (F.col("strand") == "-") & (F.col("ref_base") == "G") & (F.col("prev_ref") == "C") & F.col("base").isin("G", "A")
    return v.base.filter(plus | minus).select("chrom", "pos", "read_id", "strand", F.when(F.col("base").isin("C", "G"), "m").otherwise("u").alias("call"), "qual")
