"""Run registered queries against their SQL twins: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def kind(v) -> str:
    return v.kind if hasattr(v, "kind") else "O"


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iu" and df[c].isna().any():
            df[c] = df[c].astype("float64")  # whole numbers with gaps
        if df[c].dtype.kind in "iu":
            df[c] = df[c].astype("int64")
        elif df[c].dtype.kind == "f":
            df[c] = df[c].astype("float64") + 0.0
    keys = df.astype(object).where(df.notna(), "").astype(str).agg("|".join, axis=1) if len(df.columns) else pd.Series(dtype=str)
    return df.iloc[keys.argsort(kind="stable")].reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind and not ({a[c].dtype.kind, b[c].dtype.kind} <= set("OUT")):
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).to_numpy().argmax()
            return f"values of {c}: {int((~same).sum())} differ, e.g. {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}"
    return "ok"


def main(argv: list[str]) -> int:
    from firegrid.session import get_spark
    from __spark_entry__ import oracle_sql, queries

    d = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    sqls, bad, n = oracle_sql(), 0, 0
    for name, fn in queries().items():
        if names and not any(name == x or (x.endswith("*") and name.startswith(x[:-1])) for x in names):
            continue
        n += 1
        t0 = time.time()
        try:
            got = fn(spark, d).toPandas()
            t1 = time.time()
            if name in sqls:
                want = con.execute(sqls[name]).df()
                verdict = compare(got, want)
            else:
                verdict = "ok (rows only)" if len(got) else "EMPTY"
        except Exception as e:
            t1, got = time.time(), []
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if not verdict.startswith("ok") or (len(got) == 0):
            bad += 1
            print(f"{name}: rows={len(got)} {verdict}", flush=True)
        elif names:
            print(f"{name}: rows={len(got)} {t1 - t0:.2f}s {verdict}", flush=True)
        if t1 - t0 > float(os.environ.get("SLOW", "6")):
            print(f"   slow: {name} {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", flush=True)
    print(f"{n} checked, {bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
