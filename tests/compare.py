"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir: str, build, sql: str) -> tuple[bool, str]:
    df = build(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return False, f"{len(got)} rows, expected {len(want)}; extra {extra}; missing {missing}"
    return True, f"{len(got)} rows"


def main(sf: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    from kinspot.session import local_session

    spark = local_session(cores=8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, sf_dir, build, oracles[name])
            else:
                ok, note = True, f"{build(spark, sf_dir).count()} rows, no oracle"
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
