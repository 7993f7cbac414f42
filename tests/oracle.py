"""Compares a query with its DuckDB twin the way the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*.parquet' if Path(f'{sf_dir}/{t}.parquet').is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if type(v).__name__ == "Decimal":
        return float(v)
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_duckdb(con, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())


def differences(df, con, sql: str) -> str:
    """Empty where both give the same rows."""
    a, x = rows_of_spark(df)
    b, y = rows_of_duckdb(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum((x - y).values())} rows of Spark's {sum(x.values())} and {sum((y - x).values())} of SQL's {sum(y.values())} stand alone, such as {list((x - y).elements())[:2]} and {list((y - x).elements())[:2]}"
    return ""
