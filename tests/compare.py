"""Run a named query on Spark and its oracle on DuckDB and compare rows as multisets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clustervitals.plans.fixtures import TABLES  # noqa: E402


def norm(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (date, str, int, bool)) or value is None:
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = sys.argv[1]
    spark = make_session()
    sqls, chosen = entry.oracle_sql(), sys.argv[2:]
    bad = 0
    for name, fn in entry.queries().items():
        if chosen and name not in chosen:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols, got = spark_rows(df)
            took = time.time() - t0
            if name not in sqls:
                print(f"ROWS  {name} {sum(got.values())} {took:.2f}s")
                continue
            ocols, want = oracle_rows(sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:600]}")
            continue
        if cols != ocols or got != want:
            bad += 1
            print(f"DIFF  {name} cols {cols == ocols} {cols if cols != ocols else ''} {ocols if cols != ocols else ''} "
                  f"{sum(got.values())} vs {sum(want.values())}")
            print("   spark only", list((got - want).items())[:3])
            print("   sql only  ", list((want - got).items())[:3])
        else:
            print(f"OK    {name} {sum(got.values())} {took:.2f}s")
    print("bad", bad)
