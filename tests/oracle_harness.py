"""Run catalogued Spark queries against their DuckDB oracle SQL and compare.

Comparison: column names (sorted), row count, and the multiset of rows with
floats rounded to 6 decimals (12 significant digits from a million up). Usage:
    python -m tests.oracle_harness [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.12g}") if abs(v) >= 1e6 else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    try:
        import pandas as pd
        if v is pd.NaT or (not isinstance(v, (str, bytes, list, tuple, dict)) and pd.isna(v)):
            return None
    except Exception:
        pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf) -> tuple[list[str], Counter]:
    cols = sorted(pdf.columns)
    c = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        c[tuple(_norm(x) for x in rec)] += 1
    return cols, c


def compare(spark, sf_dir: str, keys=None, verbose=True) -> dict[str, str]:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    qs, sql = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for k in keys or qs:
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf_dir).toPandas()
        except Exception as exc:  # noqa: BLE001
            out[k] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(k, out[k]) if verbose else None
            continue
        t1 = time.time()
        if k not in sql:
            out[k] = f"rows-only ({len(sdf)} rows)"
            print(f"{k:32s} {out[k]}  spark {t1 - t0:.1f}s") if verbose else None
            continue
        try:
            ddf = con.execute(sql[k]).df()
        except Exception as exc:  # noqa: BLE001
            out[k] = f"SQL ERROR {str(exc)[:300]}"
            print(k, out[k]) if verbose else None
            continue
        sc, sr = rows_of(sdf)
        dc, dr = rows_of(ddf)
        if sc != dc:
            out[k] = f"COLUMNS differ spark={sc} sql={dc}"
        elif sr != dr:
            only_s = list((sr - dr).elements())[:3]
            only_d = list((dr - sr).elements())[:3]
            out[k] = f"VALUES differ ({len(sdf)} vs {len(ddf)} rows) spark-only={only_s} sql-only={only_d}"
        else:
            out[k] = f"ok ({len(sdf)} rows)"
        print(f"{k:32s} {out[k][:600]}  spark {t1 - t0:.1f}s") if verbose else None
    return out


if __name__ == "__main__":
    from sheaf.session import local_session
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")] or None
    spark = local_session()
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if not (v.startswith("ok") or v.startswith("rows-only"))]
    print("FAILED:", bad)
