"""Runs registered queries and their SQL side by side.

    python -m checks.compare [sf folder] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import ALL, queries


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in ALL:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, db, sf: str, name: str) -> tuple[str, float, float]:
    start = time.time()
    df = queries()[name](spark, sf)
    got = df.collect()
    spark_seconds = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)}", spark_seconds, 0.0
    start = time.time()
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    duck_seconds = time.time() - start
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", spark_seconds, duck_seconds
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return f"ok {len(a)}", spark_seconds, duck_seconds
    miss = [r for r in b if r not in a][:3] if len(b) < 5000 else b[:2]
    more = [r for r in a if r not in b][:3] if len(a) < 5000 else a[:2]
    return f"DIFF {len(a)} rows, SQL {len(b)}; only SQL {miss}; only Spark {more}", spark_seconds, duck_seconds


def session() -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("joingrove")
             .config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, db = session(), connect(folder)
    for name in sorted(queries(), key=lambda n: (n[0], int(n[1:].split("_")[0]), n)):
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            verdict, s, d = compare(spark, db, folder, name)
        except Exception as e:
            verdict, s, d = f"ERROR {type(e).__name__} {str(e)[:600]}", 0.0, 0.0
        print(f"{name:32s} {s:7.2f} {d:7.2f}  {verdict[:900]}", flush=True)
