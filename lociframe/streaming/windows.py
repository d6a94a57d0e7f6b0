"""The same summaries on static and on streaming DataFrames.

Every function takes any DataFrame with an event-time column. On a stream the watermark bounds
the state; finished windows are appended. `run_available` drives a query over the files that are
there and returns the sink as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.session import checkpoint_root


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Zoned timestamps, as watermarks require."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def watermarked(df: DataFrame, delay: str, column: str = "ts") -> DataFrame:
    return df.withWatermark(column, delay) if df.isStreaming else df


def tumbling_counts(df: DataFrame, width: str, by: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    """Counts and sums per fixed window: a position block complete once the reads have moved on."""
    w = F.window("ts", width)
    out = watermarked(df, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sliding_stats(df: DataFrame, width: str, slide: str, by: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, slide)
    out = watermarked(df, delay).groupBy(w.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean", "min", "max")


def session_domains(df: DataFrame, gap: str, by: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    """Runs of events closer than `gap`: opened, extended, and emitted when the gap has passed."""
    s = F.session_window("ts", gap)
    out = watermarked(df, delay).groupBy(s.alias("s"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n", "total")


def drop_repeats(df: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First row of each key; on a stream keys are forgotten once the watermark has passed them."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def filtered(df: DataFrame, *tests: Column) -> DataFrame:
    """Chained element predicates."""
    for t in tests:
        df = df.filter(t)
    return df


def scored_domains(df: DataFrame, passes: Column, gap: str, by: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    """Domains of passing events with the score of their first event.

    Partial sessions merge like any aggregate, so the score is the value at the earliest time.
    """
    s = F.session_window("ts", gap)
    out = watermarked(df.filter(passes), delay).groupBy(s.alias("s"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", value)).alias("f"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n", F.col(f"f.{value}").alias("score"))


def run_available(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available into a parquet table in the shared folder."""
    root = f"{checkpoint_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    _finish(writer.format("parquet").option("path", f"{root}/table").start())
    return spark.read.schema(df.schema).parquet(f"{root}/table")


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


Listener = Callable[[DataFrame, int], None]


def listen(df: DataFrame, state: str, *listeners: Listener) -> None:
    """Run a stream over everything available and hand each batch of finished rows to the listeners, in order.

    A batch comes again with the same number after a failure, so listeners that write should
    overwrite what they keep under that number (`to_table` does). An error of a listener ends the
    query. The batch is computed once for all of them.
    """
    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for listener in listeners:
                listener(held, number)
        finally:
            held.unpersist()

    _finish(df.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(each).start())


def to_table(path: str) -> Listener:
    """A listener that keeps batches as Parquet under batch=number, once however often they come."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


class OutOfOrder(RuntimeError):
    """Rows came later than allowed."""


def late_ledger(path: str, by: list[str], delay: str, fatal: bool = False, column: str = "ts") -> Listener:
    """A listener that counts rows that come later than allowed: more than `delay` before the newest row of their key in earlier batches.

    Per batch and key it keeps n_rows, n_late and the newest time so far under counts/batch=number;
    the newest times of the batch before are read from there, so a batch that is run again gives the
    same. Keys meet their rows by a join that Spark plans, no key is one task's. `fatal` raises
    `OutOfOrder` on the first late row, after the counts are written.
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select(*by, F.col(column).cast("timestamp").alias("_at"))
        kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in by)
        before = spark.read.parquet(f"{path}/counts/batch={number - 1}").select(*by, "newest") if number else spark.createDataFrame([], f"{kinds}, newest timestamp")
        seen = own.join(before.withColumnsRenamed({k: f"_k_{k}" for k in by}), _same(by), "left")
        late = F.col("_at") < F.col("newest") - F.expr(f"INTERVAL {delay}")
        counts = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(late, 1)).alias("n_late"), F.max("_at").alias("_here"))
        carried = before.withColumnsRenamed({k: f"_k_{k}" for k in by})
        merged = counts.join(carried, _same(by), "full").select(
            *[F.coalesce(k, f"_k_{k}").alias(k) for k in by], F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_late", F.lit(0)).alias("n_late"), F.greatest("_here", "newest").alias("newest"))
        merged.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        if fatal:
            n = spark.read.parquet(f"{path}/counts/batch={number}").agg(F.sum("n_late")).first()[0] or 0
            if n:
                raise OutOfOrder(f"{n} rows of batch {number} are later than {delay}")

    return each


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for k in by:
        out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def batches_of(spark: SparkSession, df: DataFrame, number: Column, n: int, path: str) -> DataFrame:
    """A stream that delivers the rows of a table in `n` batches, 0 first, by a number per row."""
    numbered = df.withColumn("_batch", number)
    for k in range(n):  # a file later than those before it, so the source takes them in this order
        numbered.filter(F.col("_batch") == k).drop("_batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def read_events(spark: SparkSession, sf_dir: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
