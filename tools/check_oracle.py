"""Compare registered queries with their SQL on DuckDB: names, types, row multisets. Usage: check_oracle.py [sf] [pattern...]"""

import fnmatch
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb

from cinelake.plans.registry import load_all
from cinelake.session import build_session

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "\0null" if v is None else repr(v)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pats = sys.argv[2:] or ["*"]
    base = f"/root/testdata/sf{sf}"
    spark = build_session("check", 8)
    con = duckdb.connect()
    for f in sorted(os.listdir(base)):
        con.execute(f"create view {f[:-8]} as select * from '{base}/{f}'")
    bad = []
    for name, q in load_all().items():
        if not any(fnmatch.fnmatch(name, p) for p in pats):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, base)
            types = dict(df.dtypes)
            rows = df.collect()
            t1 = time.time()
            cols = sorted(types)
            got = sorted(tuple(norm(r[c]) for c in cols) for r in rows)
        except Exception as e:
            print(f"FAIL {name}: spark {str(e)[:700]}")
            bad.append(name)
            continue
        if q.sql is None:
            print(f"rows {name}: {len(got)} ({t1 - t0:.2f}s) no sql")
            continue
        try:
            cur = con.execute(q.sql)
            desc = {d[0]: str(d[1]) for d in cur.description}
            want_rows = cur.fetchall()
            names = [d[0] for d in cur.description]
        except Exception as e:
            print(f"FAIL {name}: duckdb {str(e)[:700]}")
            bad.append(name)
            continue
        if sorted(names) != cols:
            print(f"FAIL {name}: columns {cols} vs {sorted(names)}")
            bad.append(name)
            continue
        order = [names.index(c) for c in cols]
        want = sorted(tuple(norm(r[i]) for i in order) for r in want_rows)
        tmis = {c: (types[c], desc[c]) for c in cols if TYPES.get(types[c]) != desc[c]}
        if tmis:
            print(f"FAIL {name}: types {tmis}")
            bad.append(name)
        elif got != want:
            a, b = set(got), set(want)
            print(f"FAIL {name}: {len(got)} vs {len(want)} rows; cols {cols}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]} ({len(a-b)})")
            bad.append(name)
        else:
            print(f"ok   {name}: {len(got)} rows spark {t1 - t0:.2f}s sql {time.time() - t1:.2f}s")
        sys.stdout.flush()
    print("BAD", bad)


main()
