"""Loads described by data: where from, and into which table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.functions.columns import col, quoted, quoted_table
from tablework.functions.rows import with_load_time
from tablework.operators.tables import (
    append_table,
    create_empty_like,
    create_entity_table,
    create_view,
    create_if_absent,
    replace_table,
    rows_view,
    upsert,
)
from tablework.plans.models import country_column, dataset_stats
from tablework.schemas import LOAD_TIME_COLUMN, UPDATE_COLUMN
from tablework.session import discard, stage
from tablework.sources.archives import list_archives, read_archives
from tablework.sources.bulkcsv import clean_text
from tablework.sources.files import read_file, read_file_or_parquet, read_json
from tablework.sources.pages import cut_pages
from tablework.sources.records import entities_of


@dataclass(frozen=True)
class LoadSpec:
    """One load job. ``schedule`` is kept for whoever starts the jobs; nothing here runs on a clock."""

    name: str
    source_type: str
    target_table: str
    source_config: dict[str, Any] = field(default_factory=dict)
    description: str = ""
    schedule: str = "@daily"


def array_rows(documents: DataFrame, key: str) -> DataFrame:
    """The elements of the array of objects under ``key`` as rows."""
    return documents.select(F.explode(col(key)).alias("row")).select("row.*")


def _from_file(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    return read_file_or_parquet(spark, config["file_path"])


def _from_landed_json(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Documents that something else fetched from the API and left under ``path``."""
    documents = read_json(spark, config["path"])
    key = config.get("data_key")
    return array_rows(documents, key) if key else documents


def _from_database(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Needs the driver of the database on the class path. ``partitionColumn``, ``lowerBound``, ``upperBound``
    and ``numPartitions`` make Spark read it in parallel."""
    return spark.read.format("jdbc").options(**config).load()


SOURCES: dict[str, Callable[[SparkSession, dict[str, Any]], DataFrame]] = {
    "file": _from_file,
    "api": _from_landed_json,
    "database": _from_database,
}


def run_load(spark: SparkSession, spec: LoadSpec) -> str:
    """Read the source, create the target if it is absent, append the rows."""
    if spec.source_type not in SOURCES:
        raise ValueError(f"unknown source type {spec.source_type}")
    rows = SOURCES[spec.source_type](spark, spec.source_config)
    create_empty_like(rows, spec.target_table)
    added = append_table(rows, spec.target_table)
    return f"Loaded {added} rows to {spec.target_table}"


def load_entities(
    spark: SparkSession,
    pages: DataFrame,
    table: str = "entities",
    path: str | None = None,
) -> int:
    """Landed pages into the entity table: cut, flatten, upsert, and create the views over it.

    The pages are written out once, so that where paging ends and what the pages hold come from one answer of the
    API. Returns the row count of the table. A step that fails raises, and the later ones do not run.
    """
    create_entity_table(spark, table, path)
    landed = stage(pages, "pages")
    rows = with_load_time(entities_of(cut_pages(landed)), LOAD_TIME_COLUMN)
    count = upsert(rows, table, dedupe_by=UPDATE_COLUMN)
    discard(landed)
    create_entity_views(spark, table)
    return count


def create_entity_views(spark: SparkSession, table: str = "entities") -> None:
    """The two views over an entity table, in the catalog, so that every session finds them."""
    rows = quoted_table(rows_view(table))
    create_view(
        spark,
        f"{table}_country_counts",
        "SELECT country, count(*) AS entity_count, count(DISTINCT jurisdiction) AS jurisdictions "
        f"FROM {rows} GROUP BY country",
    )
    create_view(
        spark,
        f"{table}_hierarchies",
        "SELECT e.lei, e.legal_name, d.legal_name AS direct_parent_name, u.legal_name AS ultimate_parent_name "
        f"FROM {rows} e LEFT JOIN {rows} d ON d.lei = e.direct_parent_lei "
        f"LEFT JOIN {rows} u ON u.lei = e.ultimate_parent_lei "
        "WHERE e.direct_parent_lei <> '' OR e.ultimate_parent_lei <> ''",
    )


def upload(spark: SparkSession, path: str, table: str) -> int:
    """A file, in the format its name says, as a new table; its row count."""
    return create_if_absent(read_file(spark, path), table)


def load_archives(spark: SparkSession, paths: str | list[str], table: str) -> dict[str, int]:
    """Archives into a bulk table that is replaced, its country view, and its numbers."""
    rows = clean_text(read_archives(list_archives(spark, paths)))
    replace_table(rows, table)
    return describe_bulk(spark, table)


def describe_bulk(spark: SparkSession, table: str) -> dict[str, int]:
    """Create the view of rows per country, if there is a country column, and count the table."""
    bulk = spark.table(table)
    column = country_column(bulk)
    if column:
        c = quoted(column)
        create_view(
            spark,
            f"{table}_by_country",
            f"SELECT {c} AS country, count(*) AS entity_count FROM {quoted_table(table)} "
            f"WHERE {c} IS NOT NULL AND {c} <> '' GROUP BY {c}",
        )
    return dataset_stats(bulk, column).first().asDict()
