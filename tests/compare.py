"""Run the named queries beside their SQL: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def difference(got, want) -> str | None:
    """Compare two Arrow tables without regard to row order; None if equal."""
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    names = sorted(got.column_names)
    for n in names:
        a, b = str(got.schema.field(n).type), str(want.schema.field(n).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            return f"type of {n}: {a} != {b}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}"
    left, right = (
        t.select(names).to_pandas().sort_values(names).reset_index(drop=True) for t in (got, want)
    )
    try:
        pd.testing.assert_frame_equal(left, right, check_exact=True, check_dtype=False)
    except AssertionError as e:
        return " ".join(str(e).split())[:400]
    return None


def run(spark, folder: str, names: list[str] | None = None) -> dict[str, str | None]:
    import __spark_entry__ as entry

    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    out = {}
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, folder).toArrow()
            took = time.time() - start
            if name in sql:
                want = con.sql(sql[name]).to_arrow_table()
                out[name] = difference(got, want)
            else:
                out[name] = None if got.num_rows else "no rows"
            print(f"{name:32s} {took:6.2f}s {got.num_rows:8d} {out[name] or 'ok'}", flush=True)
        except Exception as e:
            causes = [line.strip() for line in str(e).splitlines() if line.startswith("Caused by")]
            out[name] = " ".join([f"{type(e).__name__}: {str(e)[:600]}", *causes[:4]])
            print(f"{name:32s} FAILED {out[name]}", flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from raremill.session import build_session

    session = build_session(master="local[8]", spark__sql__shuffle__partitions="8")
    session.sparkContext.setLogLevel("OFF")
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    results = run(session, where, sys.argv[2:] or None)
    bad = {k: v for k, v in results.items() if v}
    print(f"{len(results) - len(bad)} of {len(results)} ok", *bad)
