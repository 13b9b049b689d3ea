"""Run registered queries in Spark and DuckDB on one folder and compare every value.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from ashlar.session import local_session
from checks.spark_side import QUERIES
from checks.sql_side import ORACLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in sorted(os.listdir(folder)):
        if file.endswith(".parquet"):
            name = file.removesuffix(".parquet")
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return connection


def tidy(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object).where(lambda f: f.notna(), None)
    rows = sorted(frame.itertuples(index=False, name=None), key=repr)
    return pd.DataFrame(rows, columns=frame.columns)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} against {sorted(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for c in left.columns:
        a, b = left[c].dtype.kind, right[c].dtype.kind
        if a != b:
            return f"column {c}: {left[c].dtype} against {right[c].dtype}"
    a, b = tidy(left), tidy(right)
    wrong = [i for i in range(len(a)) if repr(tuple(a.iloc[i])) != repr(tuple(b.iloc[i]))] if not a.equals(b) else []
    if wrong:
        return f"{len(wrong)} rows differ, first:\n  {tuple(a.iloc[wrong[0]])}\n  {tuple(b.iloc[wrong[0]])}"[:1500]
    return None


def main(folder: str, names: list[str]) -> int:
    spark = local_session("compare")
    sql = connect(folder)
    failed = 0
    for name in names or QUERIES:
        began = time.time()
        try:
            left = QUERIES[name](spark, folder).toPandas()
            took = time.time() - began
            if name not in ORACLES:
                print(f"rows  {name}: {len(left)} rows, {took:.2f} s", flush=True)
                continue
            began = time.time()
            found = difference(left, sql.execute(ORACLES[name]).df())
            other = time.time() - began
        except Exception as error:
            found, took, other = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - began, 0
        failed += found is not None
        print(f"{'FAIL' if found else 'ok'}  {name}: {took:.2f} s, SQL {other:.2f} s {found or f'{len(left)} rows'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
