"""Compare named queries with their SQL twins: ``python tests/compare.py [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, list):
        return tuple(map(_cell, value))
    if isinstance(value, float):
        return None if math.isnan(value) else round(value + 0.0, 6)
    return value


def rows_of(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else a short description."""
    import __spark_entry__ as entry

    got_df = entry.queries()[name](spark, sf_dir)
    got_names = got_df.columns
    got = rows_of(got_names, [tuple(r) for r in got_df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows_of(want_names, cur.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if got != want:
        a, b = got - want, want - got
        return f"{sum(got.values())} vs {sum(want.values())} rows, only spark {list(a)[:3]}, only sql {list(b)[:3]}"
    return None if got else "no rows"


if __name__ == "__main__":
    from topicflow.session import build_session

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    import __spark_entry__ as entry

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            diff = difference(spark, con, sf, name)
        except Exception as exc:
            diff = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += diff is not None
        print(f"{name:24s} {time.time() - start:6.1f}s {'ok' if diff is None else 'DIFF ' + diff[:700]}", flush=True)
    print("different:", bad)
