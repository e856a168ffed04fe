"""Run registered queries next to their SQL in DuckDB and report every difference.

    python compare.py [name prefix ...]        SF=/root/testdata/sf0.01 by default
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb

from winnow.session import local_session
from workload import all_queries, all_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    """A sortable form that keeps the type apart: a decimal or text never equals a double."""
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("f", v)
    return ("i", v) if isinstance(v, int) else ("s", str(v))


def main() -> int:
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    queries, sql = all_queries(), all_sql()
    prefixes = tuple(sys.argv[1:])
    names = [n for n in queries if not prefixes or n.startswith(prefixes)]
    spark = local_session(8, "winnow-compare")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            rows = [tuple(x) for x in df.collect()]
            spent = time.time() - start
            if name not in sql:
                print(f"rows {name} {len(rows)} {spent:.1f}s", flush=True)
                continue
            got = con.execute(sql[name])
            other = [d[0] for d in got.description]
            order = sorted(df.columns)
            left = sorted(tuple(plain(r[df.columns.index(c)]) for c in order) for r in rows)
            right = sorted(tuple(plain(r[other.index(c)]) for c in order) for r in got.fetchall()) if order == sorted(other) else None
            if left == right:
                print(f"ok   {name} {len(left)} {spent:.1f}s", flush=True)
                continue
            bad += 1
            print(f"FAIL {name}: {len(left)} rows against {None if right is None else len(right)}; columns {order} / {sorted(other)}", flush=True)
            for title, a, b in (("spark", left, set(right or [])), ("sql", right or [], set(left))):
                print("    only in", title, [x for x in a if x not in b][:2], flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERR  {name}: {str(error)[:400]}", flush=True)
    print(f"{bad} of {len(names)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
