"""Run registered questions on Spark and their oracle on DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import logging
import warnings

import duckdb
import pyarrow as pa

TESTDATA = "/root/testdata"


def open_duck(sf_dir: str):
    from lociframe.fixtures import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm_type(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t) or "string_view" in str(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def norm_value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(norm_value(x) for x in v)
    return v


def rows_of(tab: pa.Table) -> list[tuple]:
    cols = sorted(tab.column_names)
    data = [[norm_value(v) for v in tab.column(c).to_pylist()] for c in cols]
    return sorted(zip(*data), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)) if data else []


def check(spark, con, sf_dir: str, key: str, question) -> tuple[bool, str]:
    t0 = time.time()
    got = question.run(spark, sf_dir).toArrow()
    t1 = time.time()
    if question.oracle is None:
        return True, f"rows-only {got.num_rows} rows, {t1 - t0:.1f}s"
    want = con.execute(question.oracle).to_arrow_table()
    t2 = time.time()
    gt = {f.name: norm_type(f.type) for f in got.schema}
    wt = {f.name: norm_type(f.type) for f in want.schema}
    note = f"{got.num_rows} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if gt != wt:
        diff = {k: (gt.get(k), wt.get(k)) for k in set(gt) | set(wt) if gt.get(k) != wt.get(k)}
        return False, f"schema differs (spark, duck): {diff}; {note}"
    if got.num_rows != want.num_rows:
        return False, f"row count {got.num_rows} vs {want.num_rows}; {note}"
    a, b = rows_of(got), rows_of(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, cols {sorted(got.column_names)}, first {bad[0]}; {note}"
    return True, note


def main() -> None:
    warnings.simplefilter("ignore")
    logging.disable(logging.CRITICAL)
    from lociframe import plans
    from lociframe.session import get_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"{TESTDATA}/sf{sf}"
    con = open_duck(sf_dir)
    todo = plans.load()
    failed = []
    for key, question in todo.items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = check(spark, con, sf_dir, key, question)
        except Exception as exc:  # report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        print("ok  " if ok else "FAIL", key, note, flush=True)
        if not ok:
            failed.append(key)
    print("failed:", failed)


if __name__ == "__main__":
    main()
