"""Structured Streaming questions over `events`, each with the batch answer as its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.plans.aggregates import rounded
from lociframe.plans.registry import question
from lociframe.session import scratch, settle
from lociframe.streaming import windows as W


def reads_stream(v):
    """The read view on a file stream."""
    s = W.event_time(W.read_events(v.spark, v.sf_dir, v.events.schema))
    minus = ~F.col("event_type").isin("click", "view", "purchase")
    return s.select(F.col("event_id").alias("read_id"), F.concat(F.lit("chr"), (1 + F.col("user_id") % 5).cast("string")).alias("chrom"),
                    F.when(minus, "-").otherwise("+").alias("strand"), (F.floor("value") % 41).cast("bigint").alias("mapq"), "user_id", "value", "ts")


# windows end at or before the last watermark: the newest event minus the delay
CLOSED = "(SELECT max(ts) FROM v_read) - INTERVAL 1 HOUR"


@question("t_tumbling_counts", "v_read", f"""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, chrom, COUNT(*) AS n, CAST(SUM(mapq) AS BIGINT) AS total FROM v_read GROUP BY 1, 2)
SELECT epoch_us(s) AS start_us, epoch_us(s + INTERVAL 6 HOUR) AS end_us, chrom, n, total FROM w WHERE s + INTERVAL 6 HOUR <= {CLOSED}""")
def tumbling(v):
    out = W.run_available(v.spark, W.tumbling_counts(reads_stream(v), "6 hours", ["chrom"], "mapq"), "tumbling")
    return micros(out)


def micros(df):
    cols = [c for c in df.columns if c not in ("start", "end")]
    return df.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), *cols)


@question("t_sliding_stats", "v_read", f"""
WITH k AS (SELECT *, unnest(generate_series(0, 3)) AS j FROM v_read), w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - j * INTERVAL 6 HOUR AS s, strand, mapq FROM k)
SELECT epoch_us(s) AS start_us, epoch_us(s + INTERVAL 24 HOUR) AS end_us, strand, COUNT(*) AS n, ROUND(avg(mapq), 6) AS mean, min(mapq) AS min, max(mapq) AS max FROM w WHERE s + INTERVAL 24 HOUR <= {CLOSED} GROUP BY 1, 2, 3""")
def sliding(v):
    out = W.run_available(v.spark, W.sliding_stats(reads_stream(v), "24 hours", "6 hours", ["strand"], "mapq"), "sliding")
    return rounded(micros(out), "mean")


@question("t_session_domains", "v_read", f"""
WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY chrom, strand ORDER BY ts) AS p FROM v_read), g AS (SELECT *, SUM(CASE WHEN p IS NULL OR ts - p >= INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 20 MINUTE) AS end_us, chrom, strand, COUNT(*) AS n, CAST(SUM(mapq) AS BIGINT) AS total FROM g GROUP BY chrom, strand, k HAVING max(ts) + INTERVAL 20 MINUTE <= {CLOSED}""")
def sessions(v):
    return micros(W.run_available(v.spark, W.session_domains(reads_stream(v), "20 minutes", ["chrom", "strand"], "mapq"), "session"))


@question("t_drop_repeats", "v_read", "SELECT read_id FROM v_read WHERE mapq >= 5")
def drop_repeats(v):
    s = reads_stream(v)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = W.drop_repeats(W.filtered(twice, F.col("mapq") >= 5), ["read_id"])
    return W.run_available(v.spark, kept.select("read_id"), "repeats")


@question("t_scored_domains", "", """
WITH e AS (SELECT event_id, ts, concat('chr', CAST(1 + user_id % 5 AS VARCHAR)) AS chrom, value FROM events WHERE value >= 5), o AS (SELECT *, lag(ts) OVER (PARTITION BY chrom ORDER BY ts) AS p FROM e),
g AS (SELECT *, SUM(CASE WHEN p IS NULL OR ts - p >= INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 20 MINUTE) AS end_us, chrom, COUNT(*) AS n, arg_min(value, ts) AS score FROM g GROUP BY chrom, k
HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR""")
def scored(v):
    out = W.scored_domains(reads_stream(v), F.col("value") >= 5, "20 minutes", ["chrom"], "value")
    return micros(W.run_available(v.spark, out, "scored"))


@question("t_batch_tumbling", "v_read", """
SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, epoch_us(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR) AS end_us, chrom, COUNT(*) AS n, CAST(SUM(mapq) AS BIGINT) AS total FROM v_read GROUP BY 1, 2, 3""")
def batch_tumbling(v):
    return micros(W.tumbling_counts(W.event_time(v.read), "6 hours", ["chrom"], "mapq"))


@question("t_batch_sliding", "v_read", """
WITH k AS (SELECT *, unnest(generate_series(0, 3)) AS j FROM v_read), w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - j * INTERVAL 6 HOUR AS s, strand, mapq FROM k)
SELECT epoch_us(s) AS start_us, epoch_us(s + INTERVAL 24 HOUR) AS end_us, strand, COUNT(*) AS n, ROUND(avg(mapq), 6) AS mean, min(mapq) AS min, max(mapq) AS max FROM w GROUP BY 1, 2, 3""")
def batch_sliding(v):
    return rounded(micros(W.sliding_stats(W.event_time(v.read), "24 hours", "6 hours", ["strand"], "mapq")), "mean")


N_BATCHES = 4


def plain_reads(v):
    """The read view with zoned times."""
    return W.event_time(v.read)


@question("t_late_rows", "v_read", f"""
WITH b AS (SELECT chrom, ts, CAST(read_id % {N_BATCHES} AS INTEGER) AS batch FROM v_read), m AS (SELECT chrom, batch, max(ts) AS newest FROM b GROUP BY 1, 2),
p AS (SELECT x.chrom, x.batch, max(y.newest) AS newest FROM m x LEFT JOIN m y ON y.chrom = x.chrom AND y.batch < x.batch GROUP BY 1, 2)
SELECT b.batch, b.chrom, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE ts < newest - INTERVAL 6 HOUR) AS n_late, epoch_us(greatest(max(ts), max(newest))) AS newest_us FROM b JOIN p ON p.chrom = b.chrom AND p.batch = b.batch GROUP BY 1, 2""")
def late_rows(v):
    """Batches that mix all times: what comes later than six hours is counted batch by batch."""
    with scratch(v.spark) as folder:
        stream = W.batches_of(v.spark, plain_reads(v), (F.col("read_id") % N_BATCHES).cast("int"), N_BATCHES, f"{folder}/in")
        W.listen(stream, f"{folder}/state", W.late_ledger(folder, ["chrom"], "6 HOURS"))
        counts = v.spark.read.parquet(f"{folder}/counts")
        return settle(counts.select("batch", "chrom", "n_rows", "n_late", F.unix_micros("newest").alias("newest_us")))


@question("t_window_events", "v_read", f"""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, strand, COUNT(*) AS n, CAST(SUM(mapq) AS BIGINT) AS total FROM v_read GROUP BY 1, 2)
SELECT epoch_us(s) AS start_us, epoch_us(s + INTERVAL 6 HOUR) AS end_us, strand, n, total FROM w WHERE s + INTERVAL 6 HOUR <= {CLOSED}""")
def window_events(v):
    """Batches in order of time: every finished window reaches the listeners once, in the batch after which it closed."""
    reads = plain_reads(v)
    span = reads.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.struct("a", "b")).scalar()
    share = (F.unix_micros("ts") - F.unix_micros(F.col("_span.a"))) / (F.unix_micros(F.col("_span.b")) - F.unix_micros(F.col("_span.a")) + 1)
    with scratch(v.spark) as folder:
        numbered = reads.withColumn("_span", span).withColumn("_slice", F.floor(share * N_BATCHES).cast("int")).drop("_span")
        stream = W.batches_of(v.spark, numbered, F.col("_slice"), N_BATCHES, f"{folder}/in")
        W.listen(W.tumbling_counts(stream, "6 hours", ["strand"], "mapq"), f"{folder}/state", W.to_table(f"{folder}/windows"))
        return settle(micros(v.spark.read.parquet(f"{folder}/windows").drop("batch")))
