"""Run registered queries and their check statements side by side.

usage: python tools/check.py [-sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import decimal
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb
import pandas as pd

from arborscan.queries import ORACLES, QUERIES
from arborscan.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "tolist"):
        return str(value.tolist())
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def main(argv):
    sf = "0.01"
    if argv[:1] == ["-sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:
            print(f"FAIL  {name}: {str(error)[:1500]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows  {name}: {len(got)} rows {took:.2f}s  {df.dtypes}")
            continue
        try:
            rel = con.execute(ORACLES[name])
            names = [d[0] for d in rel.description]
            kinds = [str(d[1]) for d in rel.description]
            want = rel.fetchall()
        except Exception as error:
            print(f"FAIL  {name}: oracle {str(error)[:1500]}")
            bad += 1
            continue
        gc, g = rows(df.columns, got)
        wc, w = rows(names, want)
        if gc != wc:
            print(f"FAIL  {name}: columns {gc} vs {wc}")
            bad += 1
        elif g != w:
            diff = [(a, b) for a, b in zip(g, w) if a != b][:3]
            print(f"FAIL  {name}: {len(g)} vs {len(w)} rows; {diff}")
            bad += 1
        else:
            print(f"ok    {name}: {len(g)} rows {took:.2f}s")
        types = dict(df.dtypes)
        pairs = {n: (types.get(n), k) for n, k in zip(names, kinds)}
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
        odd = {n: p for n, p in pairs.items() if p[0] and same.get(p[0]) and same[p[0]] != p[1]}
        if odd:
            print("      types", odd)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
