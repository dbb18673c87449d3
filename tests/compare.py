"""Comparing a Spark result with the oracle's, as unordered rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from tablework.queries import TABLES


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in data]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def difference(spark_df, sql: str, connection) -> str | None:
    """What is different, or None."""
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    mine = rows(spark_df.columns, spark_df.collect())
    other = rows(names, relation.fetchall())
    if len(mine) != len(other):
        return f"{len(mine)} and {len(other)} rows"
    wrong = [(a, b) for a, b in zip(mine, other) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
