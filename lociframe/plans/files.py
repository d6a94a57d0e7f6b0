"""Text files written from the views and read back in many splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import methylation as M
from lociframe.operators.sequences import literal_starts
from lociframe.plans.registry import question
from lociframe.session import scratch, settle
from lociframe.sources import reads, tracks

# methylation in percent at each position and strand count, samples together
MEAN = """m AS (SELECT chrom, CAST(chrom_pos AS BIGINT) AS pos, SUM(c_reads) AS c, SUM(t_reads) AS t FROM v_cytosine GROUP BY ALL),
p AS (SELECT chrom, pos, CAST(FLOOR(100.0 * (c / CAST(c + t AS DOUBLE)) + 0.5) AS BIGINT) AS v FROM m WHERE c + t > 0)"""


def percent_track(v) -> DataFrame:
    m = v.cytosine.groupBy("chrom", F.col("chrom_pos").cast("bigint").alias("pos")).agg(F.sum("c_reads").alias("c_reads"), F.sum("t_reads").alias("t_reads"))
    return m.withColumn("f", M.frac_meth()).filter(F.col("f").isNotNull()).select("chrom", "pos", F.floor(F.lit(100.0) * F.col("f") + 0.5).cast("bigint").alias("v"))


@question("s_wig_fixed_lines", "v_cytosine", f"""
WITH {MEAN}, s AS (SELECT *, lag(pos) OVER (PARTITION BY chrom, pos // 16384 ORDER BY pos) AS before FROM p)
SELECT chrom, pos // 16384 AS tile, pos * 2 + 1 AS ord, CAST(v AS VARCHAR) AS value FROM s
UNION ALL SELECT chrom, pos // 16384, pos * 2, concat('fixedStep chrom=', chrom, ' start=', CAST(pos AS VARCHAR), ' step=1 span=1') FROM s WHERE before IS NULL OR pos - before <> 1""")
def wig_fixed_lines(v):
    return tracks.wig_lines(percent_track(v), "pos", F.col("v"), step=1)


@question("s_wig_read", "v_cytosine", f"WITH {MEAN} SELECT how, chrom, pos, CAST(v AS DOUBLE) AS value, CAST(1 AS INTEGER) AS span FROM p, (SELECT unnest(['fixed', 'variable']) AS how)")
def wig_read(v):
    """Both kinds of WIG text, read back; the files go when the result is kept."""
    track = percent_track(v)
    with scratch(v.spark) as folder:
        out = None
        for how, step in (("fixed", 1), ("variable", None)):
            tracks.write_wig(tracks.wig_lines(track, "pos", F.col("v"), step=step), f"{folder}/{how}")
            back = tracks.read_wig(v.spark, f"{folder}/{how}").select(F.lit(how).alias("how"), "chrom", "pos", "value", "span")
            out = back if out is None else out.unionByName(back)
        return settle(out)


@question("s_fasta_cpg", "v_seq", "SELECT seq_id, pos FROM (SELECT seq_id, seq, unnest(range(1, length(seq))) AS pos FROM v_seq) WHERE substr(seq, pos, 2) = 'CG'")
def fasta_cpg(v):
    """Sequences as FASTA text; CpG places from the pieces of the files."""
    with scratch(v.spark) as folder:
        reads.write_records(reads.fasta_lines(v.seq, F.col("seq_id"), F.col("seq")), folder, ["record"], ["ord"])
        pieces = reads.read_fasta_pieces(v.spark, folder, halo=1)
        found = literal_starts(pieces, "CG", reads.FASTA_PIECE)
        return settle(found.select(F.col("seq_name").cast("bigint").alias("seq_id"), F.col("pos").cast("bigint").alias("pos")))
