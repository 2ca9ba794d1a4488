"""Run registered queries against their SQL on DuckDB: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v) -> str:
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(float(v) + 0.0)
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[str, float]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return (f"rows-only {len(got)}", took)
    res = con.execute(sql)
    want_cols = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return (f"COLUMNS {sorted(df.columns)} != {sorted(want_cols)}", took)
    a, b = normal(df.columns, got), normal(want_cols, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return (f"MISMATCH rows {len(a)} vs {len(b)}: {bad}", took)
    return (f"ok {len(a)}", took)


def main() -> None:
    import __spark_entry__ as e

    from tollgate.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            result, took = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            result, took = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0
        print(f"{took:7.2f}s {name}: {result}", flush=True)


if __name__ == "__main__":
    main()
