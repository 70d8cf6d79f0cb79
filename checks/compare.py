"""Runs queries on Spark and their SQL on DuckDB and compares the values.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from tillspark.session import get_spark

from .oracles import ORACLES, full_sql
from .queries import QUERIES


def open_tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(rows: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows by value, one form for every missing value."""
    out = rows[sorted(rows.columns)].copy()
    for c in out.columns:
        col = out[c]
        if pd.api.types.is_datetime64_any_dtype(col):
            col = col.dt.strftime("%Y-%m-%d")
        out[c] = [None if v is None or v is pd.NaT or v is pd.NA or v != v else
                  (int(v) if isinstance(v, float) and v.is_integer() else v) for v in
                  col.astype(object)]
        out[c] = out[c].map(lambda v: "" if v is None else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark, con, sf: str, name: str) -> str | None:
    """None when equal, else what differs."""
    got = QUERIES[name](spark, sf)
    mine, other = got.toPandas(), con.execute(full_sql(name)).df()
    if sorted(mine.columns) != sorted(other.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(other.columns)}"
    if len(mine) != len(other):
        return f"rows {len(mine)} vs {len(other)}"
    a, b = canonical(mine), canonical(other)
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    cols = [c for c in a.columns if (a[c] != b[c]).any()]
    return f"{bad.sum()} rows differ in {cols}:\n{a[bad].head(3)}\n{b[bad].head(3)}"


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or [n for n in QUERIES if n in ORACLES]
    spark = get_spark("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = open_tables(sf), []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              + (f" {problem}" if problem else ""), flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} equal; failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
