"""Run queries beside their SQL and compare rows; also usable as a script: python tests/compare.py sf_dir [names]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return f"{v!r}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """Returns (ok, message, seconds, number of rows)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    secs = time.time() - start
    if sql is None:
        return True, "rows only", secs, len(got)
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(cols)}", secs, len(got)
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return True, f"ok (sql {duck:.1f}s)", secs, len(got)
    if len(a) != len(b):
        return False, f"{len(a)} rows / {len(b)} rows; first {a[:1]} / {b[:1]}", secs, len(got)
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return False, f"{len(only_a)} of {len(a)} rows differ: {only_a[:3]} / {only_b[:3]}", secs, len(got)


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    import __spark_entry__ as e
    sf = sys.argv[1]
    names = sys.argv[2:] or list(e.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("HOT_ROWS"):
        spark.conf.set("tallyloom.hotRows", os.environ["HOT_ROWS"])
    con = connect(sf)
    bad = []
    for n in names:
        try:
            ok, msg, secs, rows = compare(spark, con, sf, n, e.queries()[n], e.oracle_sql().get(n))
        except Exception as x:  # noqa: BLE001
            ok, msg, secs, rows = False, f"{type(x).__name__}: {str(x)[:600]}", 0, 0
        if not ok:
            bad.append(n)
        print(f"{'OK  ' if ok else 'FAIL'} {n:28s} {secs:6.2f}s rows={rows} {msg}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} agree; differ: {bad}")
