"""Runs registered queries against their DuckDB SQL: python tests/check_oracles.py [sf_dir] [name ...]"""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def compare(spark, con, sf_dir, name):
    """None if both sides agree, else a description."""
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    got_columns = sorted(df.columns)
    got = [tuple(normal(r[c]) for c in got_columns) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    want_columns = sorted(rel.columns)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    index = [rel.columns.index(c) for c in want_columns]
    want = [tuple(normal(r[i]) for i in index) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} rows vs {len(want)}; {bad}"
    return None


def session(cores=8):
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    failed = 0
    for n in names:
        t = time.time()
        try:
            problem = compare(spark, con, folder, n)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {n} {time.time() - t:.1f}s {problem or ''}"[:1500], flush=True)
    print(f"{len(names)} queries, {failed} failed")
