"""Set operations, ordering, sampling and row formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import sets as U
from lociframe.plans.aggregates import rounded
from lociframe.plans.joins import typed
from lociframe.plans.registry import question
from lociframe.plans.walks import sizes
from lociframe.sources import converters as K
from lociframe.sources import tracks as T

C, FEAT = "v_cytosine", "v_feature"


@question("u_combine_tracks", f"{C} v_read", """
SELECT chrom, chrom_pos AS pos, 'cytosine' AS source FROM v_cytosine UNION ALL SELECT chrom, start_pos, 'read' FROM v_read""")
def combine_tracks(v):
    return U.combine_tracks({"cytosine": v.cytosine.select("chrom", F.col("chrom_pos").alias("pos")),
                             "read": v.read.select("chrom", F.col("start_pos").alias("pos"))})


def coarse(v):
    return v.feature.withColumns({"start_pos": F.floor(F.col("start_pos") / 8) * 8, "end_pos": F.floor(F.col("start_pos") / 8) * 8 + 20,
                                  "gene": F.when(F.col("score") % 3 == 0, F.concat(F.lit("g"), F.col("score").cast("string")))})


COARSE = """c AS (SELECT feat_id, chrom, strand, start_pos // 8 * 8 AS start_pos, start_pos // 8 * 8 + 20 AS end_pos, CASE WHEN score % 3 = 0 THEN concat('g', CAST(score AS VARCHAR)) END AS gene FROM v_feature)"""


@question("u_dedup_exact", FEAT, f"WITH {COARSE} SELECT chrom, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, min(feat_id) AS feat_id FROM c GROUP BY 1, 2, 3")
def dedup_exact(v):
    return U.dedup_exact(coarse(v), "feat_id").select("chrom", "start_pos", "end_pos", "feat_id")


@question("u_dedup_prefer", FEAT, f"""
WITH {COARSE}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos, end_pos, strand ORDER BY gene IS NULL, feat_id) AS rn FROM c)
SELECT chrom, strand, CAST(start_pos AS BIGINT) AS start_pos, feat_id, gene FROM r WHERE rn = 1""")
def dedup_prefer(v):
    return U.dedup_prefer(coarse(v), "gene", "feat_id").select("chrom", "strand", "start_pos", "feat_id", "gene")


@question("u_except", FEAT, f"""
WITH {COARSE} SELECT feat_id FROM c WHERE (chrom, start_pos, end_pos, strand) NOT IN (SELECT chrom, start_pos, end_pos, strand FROM c WHERE feat_id % 5 = 0)""")
def except_features(v):
    c = coarse(v)
    return U.except_features(c, c.filter(F.col("feat_id") % 5 == 0)).select("feat_id")


def track(v, s, value="c_reads"):
    return v.cytosine.filter(F.col("sample") == s).select("chrom", F.col("chrom_pos").alias("pos"), F.col(value).alias("value"))


@question("u_mask", C, """
SELECT chrom, chrom_pos AS pos, c_reads AS value, TRUE AS inside FROM v_cytosine a WHERE sample = 'A' AND EXISTS (SELECT 1 FROM v_cytosine b WHERE b.sample = 'B' AND b.chrom = a.chrom AND b.chrom_pos = a.chrom_pos)
UNION ALL SELECT chrom, chrom_pos, c_reads, FALSE FROM v_cytosine a WHERE sample = 'A' AND NOT EXISTS (SELECT 1 FROM v_cytosine b WHERE b.sample = 'B' AND b.chrom = a.chrom AND b.chrom_pos = a.chrom_pos)""")
def mask(v):
    a, b = track(v, "A"), track(v, "B")
    return U.mask_track(a, b).withColumn("inside", F.lit(True)).unionByName(U.mask_track(a, b, True).withColumn("inside", F.lit(False)))


@question("u_add_tracks", C, "SELECT chrom, chrom_pos AS pos, CAST(SUM(c_reads) AS BIGINT) AS value FROM v_cytosine GROUP BY 1, 2")
def add_tracks(v):
    return U.add_tracks(track(v, "A"), track(v, "B"))


ALG = """e AS (SELECT DISTINCT chrom, feat_type, unnest(generate_series(start_pos, end_pos)) AS p FROM v_feature WHERE feat_type IN ('1-URGENT', '2-HIGH')),
k AS (SELECT chrom, p FROM e GROUP BY 1, 2 HAVING {cond}), g AS (SELECT *, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS grp FROM k)
SELECT chrom, CAST(min(p) AS BIGINT) AS start_pos, CAST(max(p) AS BIGINT) AS end_pos FROM g GROUP BY chrom, grp"""


@question("u_intersection", FEAT, "WITH " + ALG.format(cond="COUNT(*) = 2"))
def intersection(v):
    return U.location_algebra(typed(v, "1-URGENT"), typed(v, "2-HIGH"), "intersection")


@question("u_union", FEAT, "WITH " + ALG.format(cond="TRUE"))
def union(v):
    return U.location_algebra(typed(v, "1-URGENT"), typed(v, "2-HIGH"), "union")


@question("u_subtract", FEAT, "WITH " + ALG.format(cond="COUNT(*) = 1 AND min(feat_type) = '1-URGENT'"))
def subtract(v):
    return U.location_algebra(typed(v, "1-URGENT"), typed(v, "2-HIGH"), "subtract")


@question("k_genome_sort", FEAT, "SELECT feat_id, chrom, start_pos, end_pos, strand FROM v_feature ORDER BY CAST(replace(chrom, 'chr', '') AS INT), start_pos, end_pos")
def genome_sort(v):
    return U.genome_sort(v.feature.select("feat_id", "chrom", "start_pos", "end_pos", "strand"))


@question("k_first_reads", "v_read", "SELECT read_id, chrom, start_pos FROM v_read ORDER BY read_id LIMIT 100")
def first_reads(v):
    return U.first_reads(v.read.select("read_id", "chrom", "start_pos"), 100)


@question("k_shuffle_values")
def shuffle_values(v):
    d = v.cytosine.select("sample", "chrom", "chrom_pos", "c_reads", "t_reads")
    return U.shuffle_values(d, ["c_reads", "t_reads"], ["sample", "chrom"], "chrom_pos", 17)


@question("k_downsample")
def downsample(v):
    return U.downsample_counts(v.cytosine, 0.3, 5, ["c_reads", "t_reads"], ["sample", "chrom", "chrom_pos"])


@question("k_random_intervals")
def random_intervals(v):
    return U.random_intervals(v.feature.select("feat_id", "chrom", "start_pos", "end_pos"), sizes(v), 11)


@question("a_depth_subsets")
def depth_subsets(v):
    return U.depth_counts_subsets(v.base, 0.5, 3, 7)


# what a seed must not change: values and places, lengths inside the chromosomes, counts between nothing and all
@question("k_shuffle_kept", C, """SELECT 'values' AS what, sample, chrom, c_reads AS x, t_reads AS y, COUNT(*) AS n FROM v_cytosine GROUP BY ALL
UNION ALL SELECT 'places', sample, chrom, chrom_pos, NULL, COUNT(*) FROM v_cytosine GROUP BY ALL""")
def shuffle_kept(v):
    d = U.shuffle_values(v.cytosine.select("sample", "chrom", "chrom_pos", "c_reads", "t_reads"), ["c_reads", "t_reads"], ["sample", "chrom"], "chrom_pos", 17)
    values = d.select(F.lit("values").alias("what"), "sample", "chrom", F.col("c_reads").alias("x"), F.col("t_reads").alias("y"))
    places = d.select(F.lit("places").alias("what"), "sample", "chrom", F.col("chrom_pos").cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("y"))
    return values.unionByName(places).groupBy("what", "sample", "chrom", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@question("k_random_kept", f"{C} {FEAT}", "SELECT feat_id, CAST(end_pos - start_pos + 1 AS BIGINT) AS length, true AS inside FROM v_feature")
def random_kept(v):
    d = U.random_intervals(v.feature.select("feat_id", "chrom", "start_pos", "end_pos"), sizes(v), 11).join(sizes(v), "chrom")
    return d.select("feat_id", (F.col("end_pos") - F.col("start_pos") + 1).cast("bigint").alias("length"), ((F.col("start_pos") >= 1) & (F.col("end_pos") <= F.col("length"))).alias("inside"))


@question("k_downsample_bounds", C, """SELECT sample, chrom, chrom_pos, c_reads AS c_all, t_reads AS t_all, CAST(0 AS BIGINT) AS c_none, CAST(0 AS BIGINT) AS t_none, true AS within FROM v_cytosine""")
def downsample_bounds(v):
    keys = ["sample", "chrom", "chrom_pos"]
    thin = lambda frac, tag: U.downsample_counts(v.cytosine, frac, 5, ["c_reads", "t_reads"], keys).select(*keys, F.col("c_reads").alias(f"c_{tag}"), F.col("t_reads").alias(f"t_{tag}"))
    some = thin(0.3, "some")
    out = thin(1.0, "all").join(thin(0.0, "none"), keys).join(some, keys)
    return out.select(*keys, "c_all", "t_all", "c_none", "t_none", (F.col("c_some").between(0, F.col("c_all")) & F.col("t_some").between(0, F.col("t_all"))).alias("within"))


@question("a_depth_whole", "v_base", "SELECT depth, CAST(COUNT(*) AS DOUBLE) AS mean_positions FROM (SELECT chrom, pos, COUNT(*) AS depth FROM v_base GROUP BY 1, 2) GROUP BY 1")
def depth_whole(v):
    return U.depth_counts_subsets(v.tiled_bases(), 1.0, 3, 7)


@question("s_gff_line", FEAT, """
SELECT feat_id, concat_ws(chr(9), chrom, 'lib', feat_type, CAST(start_pos AS VARCHAR), CAST(end_pos AS VARCHAR), CAST(score AS VARCHAR), strand, '.',
  concat('gene_id "g', CAST(feat_id AS VARCHAR), '"; note "n', CAST(score AS VARCHAR), '";')) AS line FROM v_feature""")
def gff_line(v):
    text = F.format_string('gene_id "g%d"; drop "x"; transcript_id "t%d";', F.col("feat_id"), F.col("feat_id"))
    att = K.without_attributes(T.gff_attributes(text), ["drop", "transcript_id"])
    att = K.with_attribute(att, "note", F.concat(F.lit("n"), F.col("score").cast("string")))
    d = v.feature.select("feat_id", "chrom", F.lit("lib").alias("source"), F.col("feat_type").alias("feature"), "start_pos", "end_pos", "score", "strand",
                         F.lit(None).cast("string").alias("frame"), att.alias("attributes"))
    return d.select("feat_id", T.gff_line().alias("line"))


@question("s_count_table", C, """
SELECT chrom, chrom_pos + CASE WHEN strand = '-' THEN 1 ELSE 0 END AS chrom_pos, strand, CAST(SUM(c_reads) AS BIGINT) AS c_reads, CAST(SUM(t_reads) AS BIGINT) AS t_reads FROM v_cytosine GROUP BY 1, 2, 3""")
def count_table(v):
    return K.count_table_to_cytosines(v.cytosine.withColumnRenamed("chrom_pos", "pos"), ["c_reads", "t_reads"])


@question("s_matrix_rows", C, """
WITH g AS (SELECT chrom, chrom_pos // 100 AS r, chrom_pos % 100 // 20 AS k, SUM(c_reads) AS n FROM v_cytosine GROUP BY 1, 2, 3), x AS (SELECT DISTINCT chrom, r FROM g), y AS (SELECT x.*, k FROM x, (SELECT unnest(generate_series(0, 4)) AS k) t)
SELECT concat(y.chrom, ':', CAST(y.r AS VARCHAR)) AS "row", string_agg(coalesce(CAST(CAST(n AS BIGINT) AS VARCHAR), ''), ',' ORDER BY y.k) AS line FROM y LEFT JOIN g ON g.chrom = y.chrom AND g.r = y.r AND g.k = y.k GROUP BY 1""")
def matrix_rows(v):
    d = v.cytosine.select(F.concat_ws(":", "chrom", F.floor(F.col("chrom_pos") / 100).cast("string")).alias("row"), F.floor(F.col("chrom_pos") % 100 / 20).cast("int").alias("k"), "c_reads")
    return K.matrix_rows(d.groupBy("row", "k").agg(F.sum("c_reads").alias("n")), "row", "k", "n", 5)


@question("s_cse_line", FEAT, "SELECT concat_ws(',', replace(chrom, 'chr', ''), CAST(start_pos AS VARCHAR), CAST(end_pos AS VARCHAR)) AS line FROM v_feature")
def cse_line(v):
    return K.gff_to_cse(v.feature)


@question("s_array_matrix", C, """
WITH a AS (SELECT sample, chrom_pos % 50 AS x, chrom_pos % 40 AS y, c_reads AS value FROM v_cytosine), p AS (SELECT DISTINCT chrom_pos % 50 AS x, chrom_pos % 40 AS y FROM v_cytosine)
SELECT p.x * 100 + p.y AS probe, 'chr1' AS chrom, p.x AS pos, ROUND(avg(value) FILTER (WHERE sample = 'A'), 6) AS "A", ROUND(avg(value) FILTER (WHERE sample = 'B'), 6) AS "B" FROM a JOIN p ON p.x = a.x AND p.y = a.y GROUP BY 1, 2, 3""")
def array_matrix(v):
    xy = [(F.col("chrom_pos") % 50).alias("x"), (F.col("chrom_pos") % 40).alias("y")]
    p = v.cytosine.select(*xy).distinct()
    p = p.select("x", "y", (F.col("x") * 100 + F.col("y")).alias("probe"), F.lit("chr1").alias("chrom"), F.col("x").alias("pos"))
    return rounded(K.array_matrix(v.cytosine.select("sample", *xy, F.col("c_reads").alias("value")), p, ["A", "B"]), "A", "B")


@question("p_remap_ids", FEAT, """
SELECT f.feat_id, coalesce(c.c_name, f.name) AS name FROM (SELECT feat_id, concat('id', CAST(feat_id % (SELECT 2 * COUNT(*) FROM customer) AS VARCHAR)) AS name FROM v_feature) f LEFT JOIN customer c ON concat('id', CAST(c.c_custkey AS VARCHAR)) = f.name AND c.c_custkey % 2 = 0""")
def remap_ids(v):
    n = v.customer.agg(2 * F.count(F.lit(1))).scalar()
    f = v.feature.select("feat_id", F.concat(F.lit("id"), (F.col("feat_id") % n).cast("string")).alias("name"))
    t = v.customer.filter(F.col("c_custkey") % 2 == 0).select(F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("old_id"), F.col("c_name").alias("new_id"))
    return K.remap_ids(f, t, "name").select("feat_id", "name")


@question("p_reference_string", "v_alignment", "SELECT read_id, seq AS read, ref FROM v_alignment")
def reference_string(v):
    """The MD tag is written from both strings first, so the walk must give the reference back."""
    i = F.sequence(F.lit(1), F.length("seq"))
    at = lambda c, k: F.substring(F.col(c), k, F.lit(1))
    step = lambda acc, k: F.when(at("seq", k) == at("ref", k), F.struct(acc["t"].alias("t"), (acc["n"] + 1).alias("n"))).otherwise(
        F.struct(F.concat(acc["t"], acc["n"].cast("string"), at("ref", k)).alias("t"), F.lit(0).alias("n")))
    md = F.aggregate(i, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda acc: F.concat(acc["t"], acc["n"].cast("string")))
    d = v.alignment.select("read_id", "seq", F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), md.alias("md"))
    read, ref = K.reference_string(F.col("seq"), F.col("cigar"), F.col("md"))
    return d.select("read_id", read.alias("read"), ref.alias("ref"))


@question("p_browser_link", FEAT, "SELECT feat_id, concat('http://browser/?position=', chrom, ':', CAST(start_pos - 50 AS VARCHAR), '-', CAST(end_pos + 50 AS VARCHAR)) AS link FROM v_feature")
def browser_link(v):
    return v.feature.select("feat_id", K.browser_link(F.col("chrom"), F.col("start_pos"), F.col("end_pos"), "http://browser/?", 50).alias("link"))


