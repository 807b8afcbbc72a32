"""Runs a registered query and its SQL side by side and compares the rows."""
from __future__ import annotations

import datetime as dt
import math

import duckdb

from shopfront.plans import fixtures as fx


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in fx.GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1e9 else str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple("" if v is None else v for v in r))


def differences(spark_df, con, sql: str):
    """None when equal, else a short account."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(columns)}"
    if got == want:
        return None
    only_got, only_want = sorted(set(got) - set(want), key=str), sorted(set(want) - set(got), key=str)
    return f"rows {len(got)} vs {len(want)}; only spark {len(only_got)} {only_got[:2]}; only sql {len(only_want)} {only_want[:2]}"
