"""Compare registered queries with their SQL oracle.

    python tests/oracle.py [folder] [name ...]
"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return "~"
        if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return repr(float(x))
        return str(x)

    rows = sorted(tuple(cell(x) for x in row) for row in frame.itertuples(index=False, name=None))
    return list(frame.columns), rows


def differences(spark_frame, sql_frame):
    """None when both frames hold the same rows, else a short description."""
    a_cols, a = canonical(spark_frame)
    b_cols, b = canonical(sql_frame)
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if a != b:
        left = [r for r in a if r not in set(b)][:2]
        right = [r for r in b if r not in set(a)][:2]
        return f"{len(a)} vs {len(b)} rows; only spark {left}; only sql {right}"[:700]
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = []
    for name, run in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            if name not in oracle:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                if not len(got):
                    bad.append(name)
                continue
            want = con.execute(oracle[name]).df()
            diff = differences(got, want)
        except Exception as e:  # report and go on
            diff, took, got = f"{type(e).__name__}: {str(e)[:400]}", time.time() - start, []
        if diff or not len(got):
            bad.append(name)
            print(f"BAD  {name} {took:.1f}s {diff}", flush=True)
        else:
            print(f"ok   {name} {len(got)} {took:.1f}s", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
