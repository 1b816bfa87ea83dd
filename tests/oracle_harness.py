"""Run registered Spark queries and their DuckDB statements side by side.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Rows are compared as sorted tuples of ``str(value)`` after ordering columns by
name, which is how the correctness gate compares them.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(norm(r[c]) for c in cols) for r in sdf.collect())
    ts = time.time() - t
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(ts, 2))
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    idx = [dcols.index(c) for c in cols] if sorted(dcols) == cols else None
    if idx is None:
        return dict(name=name, ok=False, why=f"columns {cols} vs {sorted(dcols)}")
    drows = sorted(tuple(norm(r[i]) for i in idx) for r in drows_raw)
    ok = srows == drows
    out = dict(name=name, ok=ok, rows=len(srows), oracle_rows=len(drows), spark_s=round(ts, 2))
    if not ok:
        sset, dset = set(srows), set(drows)
        out["spark_only"] = list(sset - dset)[:3]
        out["oracle_only"] = list(dset - sset)[:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from ledgermesh.session import get_spark
    import __spark_entry__ as E
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as ex:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(ex).__name__}: {str(ex)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
