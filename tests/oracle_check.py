"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, status, rows spark/duckdb, seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from casework.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 6)
    return v


def normalise(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    rows = [tuple(None if (isinstance(x, float) and math.isnan(x)) else x for x in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"COLUMNS spark={sorted(spark_df.columns)} duck={sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"ROWCOUNT spark={len(spark_df)} duck={len(duck_df)}"
    a, b = normalise(spark_df), normalise(duck_df)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return f"VALUES first diff at {i}: spark={x} duck={y}"
    return "OK"


def run(spark, sf_dir: str, names: list[str] | None = None) -> dict[str, str]:
    from casework.plans.registry import load_all

    reg = load_all()
    con = duck(sf_dir)
    out = {}
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = f"SPARK-ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, out[name], flush=True)
            continue
        t1 = time.time()
        if sql is None:
            out[name] = f"NO-ORACLE rows={len(sdf)}"
        else:
            try:
                ddf = con.execute(sql).df()
                out[name] = compare(sdf, ddf) + f" rows={len(sdf)}/{len(ddf)}"
            except Exception as e:  # noqa: BLE001
                out[name] = f"DUCK-ERROR {type(e).__name__}: {str(e)[:300]}"
        print(f"{name}: {out[name]} ({t1 - t0:.1f}s)", flush=True)
    return out


if __name__ == "__main__":
    from casework.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sel = sys.argv[2:] or None
    sp = build_session()
    res = run(sp, sf, sel)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("NO-ORACLE"))}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v)
