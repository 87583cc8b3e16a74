"""Run a registered query on Spark and its SQL on DuckDB and compare all rows.

    python -m tests.oracle [sf] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

KINDS = {
    "int": "int32", "integer": "int32", "bigint": "int64", "hugeint": "int128", "double": "float", "string": "text",
    "varchar": "text", "boolean": "bool",
}


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return float(repr(x + 0.0))
    return x


def _sorted(rows, order):
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(entry, spark, con, sf: str) -> str:
    """Empty text if equal, else what differs."""
    df = entry.run(spark, sf)
    got_rows = [tuple(r) for r in df.collect()]
    if entry.sql is None:
        return "" if got_rows else "no rows"
    names = [d[0] for d in con.execute(f"DESCRIBE {entry.sql}").fetchall()]
    types = {d[0]: d[1].lower() for d in con.execute(f"DESCRIBE {entry.sql}").fetchall()}
    want_rows = con.execute(entry.sql).fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} against {names}"
    for n, t in df.dtypes:
        if KINDS.get(t, t) != KINDS.get(types[n], types[n]):
            return f"type of {n}: {t} against {types[n]}"
    cols = sorted(names)
    a = _sorted(got_rows, [df.columns.index(c) for c in cols])
    b = _sorted(want_rows, [names.index(c) for c in cols])
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, columns {cols}, first {bad[:2]}" if bad else ""


def main(argv):
    from cellview.catalog import registry
    from cellview.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.001"
    spark, con = local_session("8"), connect(sf)
    chosen = argv[1:] or list(registry())
    failed = []
    for name in chosen:
        start = time.time()
        try:
            problem = compare(registry()[name], spark, con, sf)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(chosen) - len(failed)} of {len(chosen)} equal; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
