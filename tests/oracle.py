"""Compare registered queries with their checking SQL. Usage: python tests/oracle.py [sf] [name-prefix ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

STRICT = False  # compare floats bit for bit

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return (value if STRICT else float(f"{value:.9g}")) + 0.0
    if hasattr(value, "as_tuple"):
        return float(f"{float(value):.9g}")
    if hasattr(value, "asDict"):
        return tuple(normal(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(normal(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr), [columns[i] for i in order]


def compare(df, con, sql):
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {got_cols} / {want_cols}", len(got)
    if len(got) != len(want):
        return f"row counts differ: {len(got)} / {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {got_cols}: {bad[0][0]} / {bad[0][1]}", len(got)
    return "", len(got)


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = tuple(sys.argv[2:])
    path = f"/root/testdata/sf{sf}"
    spark, con, oracle = session(), connect(path), entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if wanted and not name.startswith(wanted):
            continue
        start = time.time()
        try:
            df = run(spark, path)
            if name in oracle:
                problem, n = compare(df, con, oracle[name])
            else:
                problem, n = "", len(df.collect())
                name += " (no sql)"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:45s} {n:7d} rows {time.time() - start:6.2f}s  {problem}", flush=True)
    print("failed", failed)
