"""Runs registered queries and their SQL side by side: python tests/oracle_check.py [-s sf] [name or prefix …]"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import tempfile
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pagestrata import plans  # noqa: E402
from pagestrata.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else float(repr(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    con = duckdb.connect(config={"temp_directory": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, show=4):
    t0 = time.time()
    df = plans.QUERIES[name](spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in plans.SQL:
        return len(got) > 0, f"rows-only n={len(got)} spark={t1 - t0:.1f}s"
    rel = con.execute(plans.SQL[name])
    types = {d[0]: str(d[1]) for d in rel.description}
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    note = f"n={len(got)}/{len(want)} spark={t1 - t0:.1f}s sql={time.time() - t1:.1f}s"
    wide = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    if wide:
        note += f" WIDE {wide}"
    if got_cols != want_cols:
        return False, f"{note} columns {got_cols} vs {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        extra = sorted(a - b, key=repr)[:show]
        missing = sorted(b - a, key=repr)[:show]
        return False, f"{note}\n   cols {got_cols}\n   spark only ({len(a - b)}): {extra}\n   sql only ({len(b - a)}): {missing}"
    return len(got) > 0 and not wide, note


def main():
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("-s", default="0.001")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.s}"
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    names = [n for n in plans.QUERIES if not a.names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in a.names)]
    bad = 0
    for n in names:
        try:
            ok, note = compare(spark, con, folder, n)
        except Exception as e:
            ok, note = False, "".join(traceback.format_exception_only(e))[:900]
        bad += not ok
        print(("ok  " if ok else "BAD ") + n, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
