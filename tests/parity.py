"""Compare registered queries with their checking SQL. Usage: python tests/parity.py SF [key ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, list | tuple) or type(v).__name__ == "ndarray":
        return str([_norm(x) for x in v])
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, sf_dir, key, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not got:
        return "no rows"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{sorted(df.columns)}\n  rows {len(got)} vs {len(want)}\n  only spark {sorted(a - b)[:2]}\n  only sql {sorted(b - a)[:2]}"
    return None


def main():
    import __spark_entry__ as entry
    from tesserine.session import local_session

    sf_dir, keys = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = 0
    for k in keys or qs:
        t = time.time()
        try:
            err = check(spark, con, sf_dir, k, qs[k], os_.get(k))
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += err is not None
        print(f"{'ok  ' if err is None else 'FAIL'} {k} {time.time() - t:.1f}s{'' if k in os_ else ' (rows only)'}{'' if err is None else chr(10) + '  ' + err}", flush=True)
    print(f"{len(keys or qs)} checked, {bad} failed, {sum(k in os_ for k in (keys or qs))} with SQL")


if __name__ == "__main__":
    main()
