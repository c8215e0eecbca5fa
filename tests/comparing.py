"""Compare registered queries with their SQL checks: ``python tests/comparing.py [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v) + 0.0:.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def difference(spark, name: str, fn, sql: str | None, folder: str, con) -> str | None:
    got = fn(spark, folder).toPandas()
    if sql is None:
        return None if len(got) else "no rows"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return None if a else "both empty"


if __name__ == "__main__":
    import traceback

    from __spark_entry__ import oracle_sql, queries
    from chainsieve.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", 8)
    con = duck(folder)
    checks = oracle_sql()
    picked = [a for a in sys.argv[1:] if not a.startswith("@")]
    parts = [a[1:] for a in sys.argv[1:] if a.startswith("@")]
    failed = 0
    for name, fn in queries().items():
        if (picked or parts) and name not in picked and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            diff = difference(spark, name, fn, checks.get(name), folder, con)
        except Exception as e:  # noqa: BLE001
            diff = "".join(traceback.format_exception_only(e))[:900]
        failed += diff is not None
        tag = "ok  " if diff is None else "FAIL"
        print(f"{tag} {name} {time.time() - start:.1f}s {'' if name in checks else '(rows only) '}{diff or ''}", flush=True)
    print("failed", failed)
