"""Run queries() against oracle_sql() on DuckDB, the way the driver does.

    python tests/oracle_harness.py [sf_dir] [name ...]

Compares row count, column names, and the order-insensitive multiset of rows
(columns sorted by name).  Values are compared exactly, floats included.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return repr(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    body = sorted(tuple(norm(r[i]) for i in order) for r in rows)
    return names, body


def compare(spark, name, spec, sf_dir, con, show=5):
    t0 = time.time()
    df = spec.build(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if spec.sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2))
    res = con.execute(spec.sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sn, sb = canon(scols, srows)
    dn, db = canon(dcols, drows)
    ok = sn == dn and sb == db
    out = dict(name=name, ok=ok, rows=len(srows), oracle_rows=len(drows),
               spark_s=round(t1 - t0, 2))
    if not ok:
        out["spark_cols"], out["oracle_cols"] = sn, dn
        sset, dset = set(sb), set(db)
        out["only_spark"] = sorted(sset - dset)[:show]
        out["only_oracle"] = sorted(dset - sset)[:show]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    from txnrisk.plans.registry import load_all
    from txnrisk.session import build_session
    spark = build_session(shuffle_partitions=8)
    reg = load_all()
    con = duck(sf_dir)
    bad = 0
    for name, spec in reg.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, name, spec, sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, error=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
