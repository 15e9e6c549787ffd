"""Run every query and its SQL side by side: ``python -m tunekit_checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from tunekit.session import local_session
from tunekit_checks.oracle import oracle_sql
from tunekit_checks.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = local_session(8, app="compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), []
    for name in names:
        began = time.time()
        try:
            df = REGISTRY[name](spark, sf_dir)
            got = rows_of(df.columns, df.collect())
            took = time.time() - began
            if name not in sql:
                print(f"rows  {name} {sum(got.values())} {took:.2f}s", flush=True)
                continue
            began = time.time()
            result = con.execute(sql[name])
            columns = [d[0] for d in result.description]
            want = rows_of(columns, result.fetchall())
            ok = sorted(columns) == sorted(df.columns) and got == want
            print(
                f"{'ok   ' if ok else 'FAIL '} {name} {sum(got.values())}/{sum(want.values())} "
                f"{took:.2f}s/{time.time() - began:.2f}s",
                flush=True,
            )
            if not ok:
                bad.append(name)
                print("   ", sorted(df.columns), sorted(columns))
                for label, diff in (("spark", got - want), ("sql", want - got)):
                    for row in list(diff)[:2]:
                        print("   ", label, [str(x)[:160] for x in row], flush=True)
        except Exception as exc:
            bad.append(name)
            print(f"ERROR {name}: {str(exc)[:700]}", flush=True)
    print("failed:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
