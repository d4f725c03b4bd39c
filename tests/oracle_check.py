"""Run registered Spark queries and their DuckDB twins on the same tables and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of the rows.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TYPES = {"bigint": "int64", "int": "int32", "double": "float64", "string": "str", "boolean": "bool"}
DUCK_TYPES = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float64", "VARCHAR": "str", "BOOLEAN": "bool"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keys).encode()).hexdigest(), keys


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s_cols = sdf.columns
            s_types = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = f"spark error: {e}"[:400]
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only {len(s_rows)}"
            print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            d_cols = rel.columns
            d_types = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
            d_rows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"duckdb error: {e}"[:400]
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        if ok_cols and s_types != d_types:
            print(f"  {name}: TYPE DIFF", {c: (s_types[c], d_types[c]) for c in s_types if s_types[c] != d_types.get(c)})
        hs, ks = rows_digest(s_cols, s_rows)
        hd, kd = rows_digest(d_cols, d_rows)
        ok = ok_cols and len(s_rows) == len(d_rows) and hs == hd
        results[name] = "ok" if ok else f"MISMATCH cols={ok_cols} rows={len(s_rows)}/{len(d_rows)}"
        print(f"{name}: {results[name]} ({ts:.1f}s, {len(s_rows)} rows)", flush=True)
        if not ok and verbose:
            print("  spark cols", s_cols, "\n  duck cols ", d_cols)
            a, b = set(ks), set(kd)
            for x in list(a - b)[:3]:
                print("  only spark:", x[:300])
            for x in list(b - a)[:3]:
                print("  only duck :", x[:300])
    return results


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from transpark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if not (v == "ok" or v.startswith("rows-only"))}
    print("SUMMARY", len(res) - len(bad), "good of", len(res), bad)
