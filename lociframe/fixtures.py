"""Views that present the supplied tables in the library's own schemas.

One template per view serves both engines: Spark runs it for `queries()`,
the oracle text carries it as a leading CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"S": "STRING", "G": "", "X": "explode", "Q": "sequence", "D": "array_distinct", "A": "concat", "L": "array(", "R": ")"}
DUCK = {"S": "VARCHAR", "G": ", 'g'", "X": "unnest", "Q": "generate_series", "D": "list_distinct", "A": "list_concat", "L": "[", "R": "]"}

READ_LEN = 60
READ_STEP = 20

VIEWS = {
    "v_cytosine": """
SELECT CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS sample,
       concat('chr', CAST(1 + l_suppkey % 5 AS {S})) AS chrom,
       CAST(l_partkey * 10 + l_linenumber AS INT) AS chrom_pos,
       CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand,
       CAST(SUM(CAST(FLOOR(l_quantity) AS INT) % 11) AS BIGINT) AS c_reads,
       CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS c_reads_nonconv,
       CAST(SUM(CAST(FLOOR(l_extendedprice) AS BIGINT) % 7) AS BIGINT) AS t_reads,
       CAST(SUM(CAST(ROUND(l_tax * 100) AS INT) % 3) AS BIGINT) AS ag_reads,
       CAST(SUM(CAST(ROUND(l_discount * 100) AS INT) % 6) AS BIGINT) AS total_reads_opp,
       CAST(SUM(CASE WHEN CAST(ROUND(l_discount * 100) AS INT) % 6 >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS a_reads_opp
FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "v_feature": """
SELECT o_orderkey AS feat_id, o_orderpriority AS feat_type,
       concat('chr', CAST(1 + o_custkey % 5 AS {S})) AS chrom,
       CAST(o_orderkey AS INT) AS start_pos,
       CAST(o_orderkey + 4 + o_custkey % 36 AS INT) AS end_pos,
       CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand,
       CAST(FLOOR(o_totalprice) AS BIGINT) % 1000 AS score
FROM {orders}""",
    "v_read": """
SELECT event_id AS read_id, concat('chr', CAST(1 + user_id % 5 AS {S})) AS chrom,
       CAST(1 + (event_id * 37) % 20000 AS INT) AS start_pos,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN '+' ELSE '-' END AS strand,
       CAST(FLOOR(value) AS BIGINT) % 41 AS mapq, ts
FROM {events}""",
    "v_seq": """
SELECT doc_id AS seq_id, lang, regexp_replace(upper(text), '[^ACGT]', ''{G}) AS seq
FROM {documents}""",
    # alignments: overlapping 60-base pieces of each sequence and the piece at its end, bisulfite-like edits per read
    "v_alignment": """
SELECT seq_id * 1000000 + k AS read_id, chrom, pos0 + k AS start_pos,
       CASE WHEN (k / 20) % 2 < 1 THEN '+' ELSE '-' END AS strand,
       CAST((seq_id * 7 + k) % 41 AS BIGINT) AS mapq,
       CASE WHEN (k / 20) % 2 < 1
            THEN CASE (seq_id + k) % 3 WHEN 0 THEN replace(ref, 'CA', 'TA')
                 WHEN 1 THEN replace(replace(replace(ref, 'CA', 'TA'), 'CT', 'TT'), 'GC', 'GT')
                 ELSE replace(replace(ref, 'CC', 'TC'), 'AAG', 'ACG') END
            ELSE CASE (seq_id + k) % 3 WHEN 0 THEN replace(ref, 'TG', 'TA')
                 WHEN 1 THEN replace(replace(ref, 'TG', 'TA'), 'AG', 'AA')
                 ELSE replace(replace(ref, 'GG', 'GA'), 'TCT', 'TGT') END END AS seq,
       ref, translate(ref, 'ACGT', 'I5?+') AS qual
FROM (SELECT seq_id, concat('chr', CAST(1 + seq_id % 5 AS {S})) AS chrom,
             CAST(FLOOR(seq_id / 5) AS BIGINT) * 30000 + 1 AS pos0, k,
             substring(seq, CAST(k AS INT) + 1, 60) AS ref
      FROM (SELECT seq_id, seq, {X}({D}({A}({Q}(CAST(0 AS BIGINT), CAST(length(seq) - 60 AS BIGINT), CAST(20 AS BIGINT)), {L}CAST(length(seq) - 60 AS BIGINT){R}))) AS k
            FROM (SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', ''{G}) AS seq
                  FROM {documents}) s0 WHERE length(seq) >= 60) s1) s2""",
}

# allele-specific counts: two bases of a variant next to a cytosine
VIEWS["v_allele"] = """
SELECT concat('chr', CAST(1 + l_suppkey % 5 AS {S})) AS chrom, CAST(l_partkey * 10 + l_linenumber AS INT) AS chrom_pos,
       CAST(l_partkey * 10 + l_orderkey % 97 AS INT) AS allele_pos,
       CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'G' ELSE '0' END AS a_base, 'T' AS b_base,
       CASE WHEN l_linenumber % 4 = 0 THEN 'A' ELSE 'G' END AS next_base_ref,
       CAST(SUM(CAST(FLOOR(l_quantity) AS INT) % 11) AS BIGINT) AS a_c_reads,
       CAST(SUM(CAST(FLOOR(l_extendedprice) AS BIGINT) % 7) AS BIGINT) AS a_t_reads,
       CAST(SUM(CAST(FLOOR(l_extendedprice) AS BIGINT) % 5) AS BIGINT) AS b_c_reads,
       CAST(SUM(CAST(FLOOR(l_quantity) AS INT) % 13) AS BIGINT) AS b_t_reads,
       CAST(SUM(CAST(ROUND(l_discount * 100) AS INT)) AS BIGINT) AS total_reads_opp,
       CAST(SUM(CASE WHEN CAST(ROUND(l_discount * 100) AS INT) >= 9 THEN 2 ELSE 0 END) AS BIGINT) AS a_reads_opp
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6"""

# read bases: one row per (read, reference position)
VIEWS["v_base"] = """
SELECT read_id, chrom, start_pos + i - 1 AS pos, strand, mapq, i AS off,
       CASE WHEN strand = '+' THEN i ELSE 61 - i END AS cycle,
       substring(ref, CAST(i AS INT), 1) AS ref_base, substring(seq, CAST(i AS INT), 1) AS base,
       ascii(substring(qual, CAST(i AS INT), 1)) - 33 AS qual,
       CASE WHEN i > 1 THEN substring(ref, CAST(i - 1 AS INT), 1) END AS prev_ref,
       CASE WHEN i < 60 THEN substring(ref, CAST(i + 1 AS INT), 1) END AS next_ref,
       CASE WHEN i < 59 THEN substring(ref, CAST(i + 2 AS INT), 1) END AS next2_ref
FROM (SELECT v_alignment.*, {X}({Q}(CAST(1 AS BIGINT), CAST(60 AS BIGINT))) AS i FROM v_alignment) b0"""

NEEDS = {"v_base": ["v_alignment"]}
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _with_needs(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for dep in [*NEEDS.get(name, []), name]:
            if dep not in out:
                out.append(dep)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(sf_dir: str, name: str) -> str:
    """Table reference. Texts are spread evenly before they are cut into many rows: a few long ones,
    or one row group with all of them, would else decide the width of the job."""
    path = f"parquet.`{sf_dir}/{name}.parquet`"
    return f"(SELECT /*+ REBALANCE */ doc_id, lang, text FROM {path})" if name == "documents" else path


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """DataFrame of one fixture view over the tables in `sf_dir`."""
    parts = _with_needs([name])
    text = VIEWS[parts[-1]]
    needed = [t for t in TABLES if any("{" + t + "}" in VIEWS[p] for p in parts)]
    used = {t: _source(sf_dir, t) if t in needed else t for t in TABLES}
    ctes = ", ".join(f"{p} AS ({VIEWS[p].format(**SPARK, **used)})" for p in parts[:-1])
    body = text.format(**SPARK, **used)
    return spark.sql(f"WITH {ctes} {body}" if ctes else body)


def oracle(names: str | list[str], body: str) -> str:
    """Oracle text: fixture views as CTEs in front of `body` (which may have its own WITH)."""
    wanted = names.split() if isinstance(names, str) else names
    ident = {t: t for t in TABLES}
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n].format(**DUCK, **ident)})" for n in _with_needs(wanted)]
    text = body.strip()
    if not ctes:
        return text
    head = "WITH RECURSIVE " if text[:15].upper() == "WITH RECURSIVE " else "WITH "
    if text[:5].upper() == "WITH ":
        text = ",\n" + text[len(head) :]
    return head + ",\n".join(ctes) + "\n" + text
