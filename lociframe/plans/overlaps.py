"""Many feature types at once: tuples, shared bases, nearest feature of each type."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from lociframe.operators import overlaps as O
from lociframe.plans.aggregates import rounded
from lociframe.plans.registry import question

ALL = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MASK = " ".join(f"WHEN '{t}' THEN {1 << i}" for i, t in enumerate(ALL))
MEET = """f AS MATERIALIZED (SELECT feat_id, feat_type, chrom, start_pos, end_pos FROM v_feature),
o AS MATERIALIZED (SELECT a.feat_id AS a, b.feat_id AS b, a.feat_type AS ta, b.feat_type AS tb FROM f a JOIN f b ON a.chrom = b.chrom AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos AND a.feat_type < b.feat_type),
z AS MATERIALIZED (SELECT mask, COUNT(*) AS bases FROM (SELECT chrom, p, bit_or(CASE feat_type %s END) AS mask FROM (SELECT DISTINCT chrom, feat_type, unnest(generate_series(start_pos, end_pos)) AS p FROM f) GROUP BY ALL) GROUP BY ALL),
one AS (SELECT feat_type, COUNT(*) AS n_single FROM f GROUP BY 1)""" % MASK
N3 = "SELECT x.ta AS t1, x.tb AS t2, y.tb AS t3, x.a, x.b, y.b AS c FROM o x JOIN o y ON y.a = x.b JOIN o w ON w.a = x.a AND w.b = y.b"


def _counts(combos) -> str:
    """types, feat_type, n and bases of every combination by the joins of overlapping pairs."""
    out = []
    for combo in combos:
        mask = sum(1 << ALL.index(t) for t in combo)
        cond = {2: "FROM o WHERE ta = '{0}' AND tb = '{1}'", 3: "FROM t3 WHERE t1 = '{0}' AND t2 = '{1}' AND t3 = '{2}'",
                4: "FROM t4 WHERE t1 = '{0}' AND t2 = '{1}' AND t3 = '{2}' AND t4 = '{3}'"}[len(combo)].format(*sorted(combo))
        for t in combo:
            out.append(f"SELECT '{','.join(combo)}' AS types, '{t}' AS feat_type, (SELECT COUNT(*) {cond}) AS n, (SELECT CAST(coalesce(SUM(bases), 0) AS BIGINT) FROM z WHERE mask & {mask} = {mask}) AS bases")
    return " UNION ALL ".join(out)


SHARES = """SELECT types, feat_type, n_single, n, bases, ROUND(n / CAST(n_single AS DOUBLE), 6) AS share, n_single - n AS remainder, ROUND(1 - n / CAST(n_single AS DOUBLE), 6) AS remainder_share FROM c JOIN one USING (feat_type)"""


@question("a_feature_overlap_quads", "v_feature", f"""WITH {MEET}, t3 AS MATERIALIZED ({N3}),
t4 AS MATERIALIZED (SELECT t3.*, d.tb AS t4 FROM t3 JOIN o d ON d.a = t3.c JOIN o e ON e.a = t3.a AND e.b = d.b JOIN o g ON g.a = t3.b AND g.b = d.b),
c AS ({_counts([c for n in (2, 3, 4) for c in combinations(ALL, n)])}) {SHARES}""")
def feature_overlap_quads(v):
    out = O.overlap_shares(v.feature, ALL).withColumns({c: F.col(c).cast("bigint") for c in ("n", "remainder")})
    return rounded(out, "share", "remainder_share")


@question("a_feature_overlap_master", "v_feature", f"""WITH {MEET}, c AS ({_counts([('3-MEDIUM', t) for t in ALL if t != '3-MEDIUM'])}) {SHARES}""")
def feature_overlap_master(v):
    out = O.overlap_shares(v.feature, ALL, master="3-MEDIUM").withColumns({c: F.col(c).cast("bigint") for c in ("n", "remainder")})
    return rounded(out, "share", "remainder_share")


FLANK = 30
#: nearest by a join of all pairs within reach; a sign says on which side of the feature the target lies
NEAR = """t AS MATERIALIZED (SELECT read_id AS feat_id, chrom, CAST(start_pos AS BIGINT) AS start_pos, CAST(start_pos + 9 AS BIGINT) AS end_pos FROM v_read),
k AS (SELECT t.feat_id, f.feat_type, CASE WHEN f.start_pos > t.end_pos THEN f.start_pos - t.end_pos WHEN f.end_pos < t.start_pos THEN t.start_pos - f.end_pos ELSE 0 END AS dist,
  f.start_pos > t.end_pos AS after, CASE f.strand WHEN '+' THEN 0 WHEN '-' THEN 1 ELSE 2 END AS r
  FROM t JOIN v_feature f ON f.chrom = t.chrom AND f.start_pos <= t.end_pos + {flank} AND f.end_pos >= t.start_pos - {flank}),
g AS (SELECT feat_id, feat_type, CASE WHEN after AND r = 0 OR NOT after AND r = 1 THEN -dist ELSE dist END AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY feat_id, feat_type ORDER BY dist, after, r) AS rn FROM k) WHERE rn = 1),
w AS MATERIALIZED (SELECT t.feat_id, chrom, start_pos, end_pos, """ + ", ".join(f"max(CASE WHEN feat_type = '{t}' THEN d END) AS d{i}" for i, t in enumerate(ALL)) + """ FROM t LEFT JOIN g ON g.feat_id = t.feat_id GROUP BY ALL)
SELECT feat_id, chrom, start_pos, end_pos, """
EMPTY = " AND ".join(f"d{i} IS NULL" for i in range(len(ALL)))
TOTALS = f""", CAST(CASE WHEN {EMPTY} THEN 1 ELSE 0 END AS BIGINT) AS none FROM w
UNION ALL SELECT NULL, NULL, NULL, NULL, {", ".join(f"COUNT(d{i})" for i in range(len(ALL)))}, CAST(SUM(CASE WHEN {EMPTY} THEN 1 ELSE 0 END) AS BIGINT) FROM w"""


def _windows(v):
    """Ten bases from each read start."""
    return v.read.select(F.col("read_id").alias("feat_id"), "chrom", "start_pos", (F.col("start_pos") + 9).alias("end_pos"))


@question("a_feature_columns", "v_feature v_read", "WITH " + NEAR.format(flank=0) + ", ".join(f"CAST(d{i} IS NOT NULL AS BIGINT) AS d{i}" for i in range(len(ALL))) + TOTALS)
def feature_columns(v):
    return O.feature_columns(_windows(v), v.feature, ALL)


@question("a_feature_distances", "v_feature v_read", "WITH " + NEAR.format(flank=FLANK) + ", ".join(f"CAST(d{i} AS BIGINT) AS d{i}" for i in range(len(ALL))) + TOTALS)
def feature_distances(v):
    return O.feature_columns(_windows(v), v.feature, ALL, FLANK)
