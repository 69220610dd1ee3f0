"""Runs queries beside their SQL in DuckDB and compares rows; python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys

import duckdb


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    order = [rel.columns.index(n) for n in names]
    return names, sorted((tuple(normal(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(v) for v in r) for r in df.select(*names).collect()), key=repr)


def check(spark, sf_dir: str, f, sql: str) -> str:
    """Empty if both agree, else what differs."""
    a, b = spark_rows(f(spark, sf_dir)), oracle_rows(sf_dir, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        x, y = [r for r in a[1] if r not in set(b[1])], [r for r in b[1] if r not in set(a[1])]
        return f"{len(a[1])} and {len(b[1])} rows; only here {x[:2]}; only there {y[:2]}"
    return ""


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from tests.conftest import session

    spark = session()
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            s = e.oracle_sql().get(name)
            said = check(spark, sys.argv[1], f, s) if s else f"rows only: {f(spark, sys.argv[1]).count()}"
        except Exception as x:  # a report of all queries
            said = f"{type(x).__name__}: {str(x)[:700]}"
        print(name, f"{time.time() - t:.1f}s", said or "ok", flush=True)
