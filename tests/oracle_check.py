"""Run every query of ``__spark_entry__`` next to its DuckDB oracle and compare.

Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``.  Compares row
count, column names and the sorted values (doubles to 1e-6).
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: tuple(x) if isinstance(x, (list, np.ndarray)) else x)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame, tol: float = 1.5e-6) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    a, b = _norm(a), _norm(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            d = np.abs(x.to_numpy(float) - y.to_numpy(float))
            if len(d) and np.nanmax(d) > tol:
                i = int(np.nanargmax(d))
                return f"column {c}: max diff {d[i]} at {i}: {x.iloc[i]} vs {y.iloc[i]}"
        elif not (x.astype(str).to_numpy() == y.astype(str).to_numpy()).all():
            i = int(np.argmax(x.astype(str).to_numpy() != y.astype(str).to_numpy()))
            return f"column {c}: {x.iloc[i]!r} vs {y.iloc[i]!r}"
    return None


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from matstream.session import local_session

    if os.environ.get("PLAIN_SESSION"):
        # what a bare driver session looks like: no time zone pinning, default AQE / Arrow settings
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = duck(sf_dir)
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            got = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"ROWS {name}: {len(got)} rows ({t1 - t0:.1f}s), no oracle")
            continue
        try:
            want = con.sql(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        err = compare(got, want)
        print(("OK   " if err is None else "FAIL ") + f"{name}: {len(got)} rows ({t1 - t0:.1f}s)"
              + ("" if err is None else f" -- {err}"))
        bad += err is not None
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
