"""Run registered queries next to their SQL: ``python tests/check_oracles.py [sf dir] [names...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float", "BLOB": "binary"}


def connect(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows_key(rows):
    return sorted((tuple((v is None, v) for v in r) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if both give the same columns, types and rows, else what differs."""
    names = sorted(df.columns)
    types = dict(df.dtypes)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    odd = {c: (types[c], kinds[c]) for c in names if types[c] != kinds[c]}
    right = rows_key([tuple(r[cols.index(n)] for n in names) for r in cur.fetchall()])
    left = rows_key([tuple(r[n] for n in names) for r in df.collect()])
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if repr(a) != repr(b):
            return f"value {[x[1] for x in a]} != {[x[1] for x in b]} {odd or ''}"
    return f"types {odd}" if odd else None


def main() -> int:
    import __spark_entry__ as e
    from splitframe import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    spark, con = local_session("8"), connect(sf)
    oracles, bad = e.oracle_sql(), 0
    for name in names:
        t = time.time()
        try:
            df = e.queries()[name](spark, sf)
            problem = compare(df, con, oracles[name]) if name in oracles else (None if df.collect() else "no rows")
        except Exception as x:
            problem = f"{type(x).__name__}: {str(x)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
