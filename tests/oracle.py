"""Compare registered queries with their SQL on the supplied tables.

``python -m tests.oracle [name-part ...]`` checks a selection at sf0.01.
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(pdf.columns)
    out = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    keys = [out[c].map(lambda v: (v is None, str(v))) for c in cols]
    order = sorted(range(len(out)), key=lambda i: tuple(k.iloc[i] for k in keys))
    return out.iloc[order].reset_index(drop=True)


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    """None when equal, else a short text."""
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(sql_pdf.columns)}"
    if len(spark_pdf) != len(sql_pdf):
        return f"rows {len(spark_pdf)} vs {len(sql_pdf)}"
    a, b = _sorted(spark_pdf), _sorted(sql_pdf)
    bad = {}
    for c in a.columns:
        diff = [i for i, (x, y) in enumerate(zip(a[c], b[c])) if x != y and not (x is None and y is None)]
        if diff:
            bad[c] = (len(diff), a[c].iloc[diff[0]], b[c].iloc[diff[0]])
    return f"values {bad}" if bad else None


def check(spark, con, sf_dir: str, name: str):
    """(verdict, rows, seconds of the Spark side)."""
    from catalog.all import REGISTRY

    q = REGISTRY[name]
    start = time.time()
    got = q.build(spark, sf_dir).toPandas()
    took = time.time() - start
    if q.sql is None:
        return "no-sql", len(got), took
    return differences(got, con.execute(q.sql).df()) or "ok", len(got), took


def main(parts: list[str]) -> int:
    from catalog.all import REGISTRY
    from tickspark.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if parts and parts[0].startswith("/"):
        sf_dir, parts = parts[0], parts[1:]
    names = [n for n in REGISTRY if not parts or any(n.startswith(p) for p in parts)]
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        try:
            verdict, rows, took = check(spark, con, sf_dir, name)
        except Exception as err:  # report and go on with the next query
            verdict, rows, took = f"ERROR {type(err).__name__}: {str(err)[:400]}", -1, 0.0
        failed += verdict not in ("ok", "no-sql")
        print(f"{name:38s} {rows:8d} {took:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
