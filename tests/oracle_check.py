"""Local twin of the driver's correctness gate: Spark query vs DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive value multiset.
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if os.environ.get("ORACLE_EXACT") else round(v, 9)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            spdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = f"rows-only {len(spdf)}"
            print(f"{name:32s} {results[name]}  spark {t1-t0:.1f}s", flush=True)
            continue
        try:
            ddf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCKDB ERROR {e}"
            print(name, results[name][:500], flush=True)
            continue
        sc, sr = rows_of(spdf)
        dc, dr = rows_of(ddf)
        ok = sc == dc and len(sr) == len(dr) and sr == dr
        results[name] = "OK" if ok else "MISMATCH"
        print(f"{name:32s} {results[name]:9s} rows {len(sr)}/{len(dr)} spark {t1-t0:.1f}s", flush=True)
        if not ok and verbose:
            if sc != dc:
                print("   cols spark", sc, "\n   cols duck ", dc)
            else:
                a, b = set(sr), set(dr)
                print("   spark-only", sorted(a - b, key=repr)[:5])
                print("   duck-only ", sorted(b - a, key=repr)[:5])
    return results


if __name__ == "__main__":
    from qualitas.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v not in ("OK",) and not v.startswith("rows-only")]
    print("SUMMARY", len(res) - len(bad), "ok /", len(res), "bad:", bad)
