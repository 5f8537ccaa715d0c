"""Compare registered queries with their SQL twins: python tests/check_oracle.py [sf] [name ...]."""

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from gaugeflow.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def table(columns, rows):
    """Rows as sorted text with columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([str([r[i] for i in order]) for r in rows])


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return bool(got[1]), f"{spent:6.1f}s rows {len(got[1])} (no SQL)"
    rel = con.execute(sql)
    want = table([d[0] for d in rel.description], rel.fetchall())
    note = f"{spent:6.1f}s rows {len(got[1])} / {len(want[1])}"
    if got == want:
        return bool(got[1]), note
    pairs = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return False, f"{note} columns {got[0] == want[0]} differing {len(pairs)}: {pairs[:2]}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(queries())
    folder = f"/root/testdata/sf{sf}"
    session, duck = local_session(), connect(folder)
    bad = []
    for query_name in names:
        try:
            ok, text = compare(session, duck, folder, query_name)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", query_name, text, flush=True)
        bad += [] if ok else [query_name]
    print("failed:", bad)
