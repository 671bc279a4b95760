"""Run registered queries on Spark and their oracle SQL on DuckDB, and
compare row count, column names and an order-insensitive value hash.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    normed = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return hashlib.sha256(repr(normed).encode()).hexdigest()[:16], normed


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as ex:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"spark: {ex}"[:400]}
            continue
        t1 = time.time()
        if name not in sqls:
            out[name] = {"ok": None, "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
            continue
        try:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_rows = [tuple(r) for r in cur.fetchall()]
        except Exception as ex:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"duckdb: {ex}"[:400]}
            continue
        sh, sn = digest(s_rows, s_cols)
        dh, dn = digest(d_rows, d_cols)
        ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and sh == dh
        rec = {"ok": ok, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2)}
        if sorted(s_cols) != sorted(d_cols):
            rec["cols"] = [s_cols, d_cols]
        if not ok and sorted(s_cols) == sorted(d_cols):
            diff_s = [r for r in sn if r not in set(dn)][:3]
            diff_d = [r for r in dn if r not in set(sn)][:3]
            rec["spark_only"] = repr(diff_s)[:600]
            rec["oracle_only"] = repr(diff_d)[:600]
        out[name] = rec
        if verbose:
            print(name, json.dumps(rec, default=str), flush=True)
    return out


if __name__ == "__main__":
    from tillroll.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if not v.get("ok")]
    print("FAILED:", bad)
    print(f"{len(res) - len(bad)}/{len(res)} ok")
