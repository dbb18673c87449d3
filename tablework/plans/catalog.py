"""What tables there are, what is in them, and answers to SQL text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from tablework.functions.columns import quoted_table

PREVIEW_ROWS = 100


def list_tables(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables()]


def list_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table)]


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: list[dict[str, str]]
    row_count: int


def describe(spark: SparkSession, table: str) -> TableInfo:
    df = spark.table(table)
    return TableInfo(table, [{"name": n, "type": t} for n, t in df.dtypes], df.count())


def preview(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, in no particular order unless ``df`` has one."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return df.limit(limit)


def records(df: DataFrame, limit: int = PREVIEW_ROWS) -> dict:
    """At most ``limit`` rows as dictionaries, and the column names."""
    df = with_unique_names(df)
    return {"data": _dicts(preview(df, limit).collect()), "columns": df.columns}


def _dicts(rows: list[Row]) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows]


def with_unique_names(df: DataFrame) -> DataFrame:
    """Equal column names told apart by a number, as ``id`` and ``id_1``, so that none is lost in a dictionary."""
    names, taken = [], set(df.columns)
    for name in df.columns:
        new, n = name, 0
        while new in names or (n and new in taken):
            n += 1
            new = f"{name}_{n}"
        names.append(new)
    return df.toDF(*names) if names != df.columns else df


def preview_table(spark: SparkSession, table: str, limit: int = PREVIEW_ROWS) -> dict:
    return records(spark.table(table), limit)


@dataclass(frozen=True)
class SqlResult:
    """Rows of a query, their number and whether there are more, or the message of a command."""

    columns: list[str] = field(default_factory=list)
    data: list[dict] = field(default_factory=list)
    row_count: int = 0
    more: bool = False
    message: str | None = None


def sql_frame(spark: SparkSession, query: str) -> DataFrame:
    """The result of any Spark SQL statement as a frame, with unique column names; a command has been run by then."""
    try:
        return with_unique_names(spark.sql(query.strip().rstrip(";")))
    except PySparkException as failure:
        raise ValueError(_explained(failure)) from failure


def run_sql(spark: SparkSession, query: str, limit: int | None = None) -> SqlResult:
    """Run any Spark SQL statement. Whether it is a query shows in its result, not in its first word.

    All rows come back unless ``limit`` bounds them; ``more`` then says whether some were left out. A result too large
    for one machine is what ``sql_frame`` and ``create_table_as`` are for. The query runs once.
    """
    df = sql_frame(spark, query)
    if not df.columns:
        return SqlResult(message="Query executed successfully")
    try:
        rows = (df if limit is None else df.limit(limit + 1)).collect()
    except PySparkException as failure:
        raise ValueError(_explained(failure)) from failure
    kept = rows if limit is None else rows[:limit]
    return SqlResult(df.columns, _dicts(kept), len(kept), len(rows) > len(kept))


def _explained(failure: PySparkException) -> str:
    text = str(failure)
    if any(word in text for word in ("UPDATE TABLE", "DELETE", "MERGE INTO")):
        return f"this kind of table has no row-level changes, use upsert or replace it: {text}"
    return text


def create_table_as(spark: SparkSession, table: str, query: str) -> None:
    spark.sql(f"CREATE TABLE {quoted_table(table)} USING parquet AS {query}")
