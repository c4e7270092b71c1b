"""Holds a query against DuckDB on the same Parquet files."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(x):
    """A value as both engines give it: floats to 5 places, nested values as tuples."""
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return bytes(x) if isinstance(x, bytearray) else x


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str = SMALL) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def assert_same(df, sql: str, sf_dir: str = SMALL) -> int:
    """Equal names and rows, floats to 1e-5 apart at most; the number of rows."""
    (n1, r1), (n2, r2) = spark_rows(df), duck_rows(sql, sf_dir)
    assert n1 == n2, f"columns {n1} and {n2}"
    assert len(r1) == len(r2), f"{len(r1)} and {len(r2)} rows; {r1[:3]} and {r2[:3]}"
    for a, b in zip(r1, r2):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5, f"{a} and {b}"
    return len(r1)
