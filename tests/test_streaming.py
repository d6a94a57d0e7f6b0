"""Streams with late rows, listeners and failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lociframe.streaming import windows as W

BASE = dt.datetime(2024, 1, 1)
# batch, key, hour
ROWS = [(0, "a", 10), (0, "a", 2), (0, "b", 5), (0, None, 9), (1, "a", 9), (1, "a", 7), (1, "b", 20), (1, None, 1), (2, "a", 11), (2, "b", 18), (2, "b", 16), (2, "c", 0), (3, "a", 1), (3, "c", 0)]


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(k, key, BASE + dt.timedelta(hours=h), h) for k, key, h in ROWS]
    table = spark.createDataFrame(rows, "k int, key string, ts timestamp, v int")
    return W.batches_of(spark, table, F.col("k"), 4, str(tmp_path / "in"))


def plain(hours):
    """Counts by the letter: batch, key, rows, late rows, newest hour."""
    out, newest = [], {}
    for batch in range(4):
        mine = [(key, h) for k, key, h in ROWS if k == batch]
        keys = {key for key, _ in mine} | set(newest)
        for key in keys:
            found = [h for x, h in mine if x == key]
            out.append((batch, key, len(found), sum(key in newest and h < newest[key] - hours for h in found)))
        for key, h in mine:
            newest[key] = max(newest.get(key, h), h)
    return sorted(out, key=str)


@pytest.mark.parametrize("hours", [0, 2, 100])
def test_late_rows_are_counted(spark, stream, tmp_path, hours):
    W.listen(stream, str(tmp_path / "state"), W.late_ledger(str(tmp_path), ["key"], f"{hours} HOURS"))
    got = [(r.batch, r.key, r.n_rows, r.n_late) for r in spark.read.parquet(str(tmp_path / "counts")).collect()]
    assert sorted(got, key=str) == plain(hours)


def test_late_rows_are_fatal(spark, stream, tmp_path):
    with pytest.raises(Exception, match="rows of batch 1 are later than 2 HOURS"):
        W.listen(stream, str(tmp_path / "state"), W.late_ledger(str(tmp_path), ["key"], "2 HOURS", fatal=True))
    late = {r.batch: r.n for r in spark.read.parquet(str(tmp_path / "counts")).groupBy("batch").agg(F.sum("n_late").alias("n")).collect()}
    assert late == {0: 0, 1: 2}  # the counts of the batch that failed are there


def test_listeners_get_windows_once_and_again_after_a_failure(spark, stream, tmp_path):
    """The second listener fails at first; the batch comes again and nothing is kept twice."""
    calls, broken = [], [True]

    def unsteady(batch, number):
        calls.append((number, batch.count()))
        if number == 1 and broken:
            broken.pop()
            raise ValueError("lost")

    counted = W.tumbling_counts(stream, "4 hours", ["key"], "v", delay="100 hours")
    listeners = [W.to_table(str(tmp_path / "out")), unsteady]
    with pytest.raises(Exception, match="lost"):
        W.listen(counted, str(tmp_path / "state"), *listeners)
    W.listen(counted, str(tmp_path / "state"), *listeners)
    assert [n for n, _ in calls][:3] == [0, 1, 1]
    assert spark.read.schema("start timestamp, end timestamp, key string, n long, total long, batch int").parquet(str(tmp_path / "out")).count() == 0  # nothing has closed

    counted = W.tumbling_counts(W.batches_of(spark, spark.createDataFrame([(0, "a", BASE, 1), (1, "a", BASE + dt.timedelta(hours=9), 2), (2, "a", BASE + dt.timedelta(hours=30), 3)], "k int, key string, ts timestamp, v int"),
                                             F.col("k"), 3, str(tmp_path / "in2")), "4 hours", ["key"], "v", delay="1 hour")
    W.listen(counted, str(tmp_path / "state2"), W.to_table(str(tmp_path / "out2")))
    got = sorted((r.start, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out2")).collect())
    assert got == [(BASE, 1, 1), (BASE + dt.timedelta(hours=8), 1, 2)]
