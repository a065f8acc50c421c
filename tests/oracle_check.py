"""Compare registered Spark queries with their DuckDB oracle SQL.

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: rows, schema match, exact / tolerant value match.
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
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
        return v
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return v.item()
        except Exception:
            return v
    return v


def frame_rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return cols, sorted(rows, key=key)


def compare(a: pd.DataFrame, b: pd.DataFrame, rel=1e-9):
    ca, ra = frame_rows(a)
    cb, rb = frame_rows(b)
    if ca != cb:
        return False, False, f"columns differ: {ca} vs {cb}"
    if len(ra) != len(rb):
        return False, False, f"row count {len(ra)} vs {len(rb)}"
    exact = ra == rb
    if exact:
        return True, True, ""
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, (float, int)) and v is not None:
                if not math.isclose(u, v, rel_tol=rel, abs_tol=1e-9):
                    return False, False, f"value {u} vs {v} in {x} / {y}"
            elif u != v:
                return False, False, f"value {u!r} vs {v!r} in {x} / {y}"
    return False, True, "tolerant only"


def run(sf_dir: str, names=None, spark=None):
    import __spark_entry__ as E
    from ledgerflow.session import local_session
    spark = spark or local_session(8)
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or q):
        t0 = time.time()
        try:
            sdf = q[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa
            results[name] = ("spark-error", str(e)[:400])
            print(f"{name:28s} SPARK ERROR {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in o:
            results[name] = ("rows-only", len(sdf))
            print(f"{name:28s} rows={len(sdf):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            odf = con.sql(o[name]).df()
        except Exception as e:  # noqa
            results[name] = ("sql-error", str(e)[:400])
            print(f"{name:28s} SQL ERROR {str(e)[:600]}")
            continue
        exact, tol, msg = compare(sdf, odf)
        dt_s = {c: str(t) for c, t in sdf.dtypes.items()}
        dt_o = {c: str(t) for c, t in odf.dtypes.items()}
        if dt_s != dt_o:
            msg = (msg + " DTYPES " + str({c: (dt_s.get(c), dt_o.get(c)) for c in set(dt_s) | set(dt_o)
                                          if dt_s.get(c) != dt_o.get(c)})).strip()
        results[name] = ("exact" if exact else "tolerant" if tol else "MISMATCH", msg)
        print(f"{name:28s} rows={len(sdf):7d}/{len(odf):7d} {'EXACT' if exact else 'tol' if tol else 'MISMATCH'} "
              f"{ts:.1f}s {msg[:300]}")
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    run(sf, sys.argv[2:] or None)
