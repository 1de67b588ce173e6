"""Run a query and its DuckDB statement on the same tables and compare the rows.

``python -m caseweave.checks.compare [-d sf_dir] [name ...]``
"""

from __future__ import annotations

import argparse
import glob
import os
import tempfile
import time
import traceback

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]

    def cell(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
            return repr(float(v) + 0.0)
        return repr(v)

    return names, sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, query, sql):
    """(row count, None) on a match, else (row count, what differs)."""
    df = query(spark, sf_dir)
    got_names, got = normalised(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    want_names, want = normalised([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return len(got), f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        left, right = set(got) - set(want), set(want) - set(got)
        return len(got), (
            f"{len(got)} rows != {len(want)}\n  spark {sorted(left)[:2]}\n  duck  {sorted(right)[:2]}"
        )
    for a, b in zip(got, want):
        if a != b:
            return len(got), f"{got_names}\n  spark {a}\n  duck  {b}"
    return len(got), None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    from caseweave.checks.oracles import ORACLES
    from caseweave.checks.queries import QUERIES
    from caseweave.runtime import local_session, work_area

    spark, con = local_session(8, folder=tempfile.mkdtemp(prefix="caseweave-")), connect(args.d)
    for name in args.names or QUERIES:
        start = time.time()
        try:
            with work_area(spark):
                n, problem = compare(spark, con, args.d, QUERIES[name], ORACLES.get(name))
            state = "rows only" if name not in ORACLES else "ok" if problem is None else "DIFFERS"
        except Exception:
            n, problem, state = 0, traceback.format_exc()[-1800:], "FAILED"
        print(f"{state:9} {name:26} {n:8} rows {time.time() - start:6.1f}s", flush=True)
        if problem:
            print(problem, flush=True)


if __name__ == "__main__":
    main()
