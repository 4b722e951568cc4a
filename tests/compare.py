"""Run queries in Spark and their SQL twins in DuckDB and compare the rows."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    import datetime
    import decimal

    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        f = float(value)
        return int(f) if f.is_integer() else round(f, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(name, spark, con, sf_dir, queries, oracles):
    df = queries[name](spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return len(got), None
    cur = con.execute(oracles[name])
    names = [c[0] for c in cur.description]
    want_cols, want = rows_of(names, cur.fetchall())
    if cols != want_cols:
        return len(got), f"columns {cols} != {want_cols}"
    if got != want:
        a = [r for r in got if r not in set(want)][:3]
        b = [r for r in want if r not in set(got)][:3]
        return len(got), f"rows {len(got)} vs {len(want)}\n   spark {a}\n   sql   {b}"
    return len(got), None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            n, problem = compare(name, spark, con, sf_dir, queries, oracles)
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        note = "FAIL " + problem if problem else ("ok" if name in oracles else "rows")
        empty = "  EMPTY" if n == 0 else ""
        print(f"{name:26s} {n:7d} {time.time() - start:6.2f}s {note}{empty}", flush=True)
    print(f"{len(wanted)} run, {bad} bad")


if __name__ == "__main__":
    main()
