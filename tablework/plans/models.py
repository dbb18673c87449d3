"""The derived tables: functions from an entity frame to a frame, and their registry."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.functions.columns import col, not_blank, pick_column
from tablework.operators.skew import hot_keys, lookup
from tablework.operators.tables import replace_table
from tablework.schemas import (
    COUNTRY_CANDIDATES,
    REGION_GROUPS,
    REGION_OTHER,
    SUMMARY_COLUMNS,
)


def active_entities(entities: DataFrame) -> DataFrame:
    """The summary columns of the active entities (those the input has)."""
    present = [c for c in SUMMARY_COLUMNS if c in entities.columns]
    return entities.filter(F.col("status") == "ACTIVE").select(*present)


def country_counts(entities: DataFrame) -> DataFrame:
    """Entities and distinct jurisdictions per country; null and empty countries are groups."""
    return entities.groupBy("country").agg(
        F.count("*").alias("entity_count"),
        F.count_distinct("jurisdiction").alias("jurisdictions"),
    )


def country_column(df: DataFrame) -> str | None:
    return pick_column(df.columns, COUNTRY_CANDIDATES)


def country_counts_clean(df: DataFrame, column: str | None = None) -> DataFrame:
    """Rows per country, without null and empty countries."""
    column = column or country_column(df)
    if column is None:
        raise LookupError("no country column")
    return (
        df.filter(not_blank(col(column)))
        .groupBy(col(column).alias("country"))
        .agg(F.count("*").alias("entity_count"))
    )


def by_size(counts: DataFrame) -> DataFrame:
    """Largest group first, equal groups by name. Sort when reading: a view keeps no order."""
    return counts.orderBy(F.desc("entity_count"), F.asc("country"))


def dataset_stats(df: DataFrame, column: str | None = None) -> DataFrame:
    """One row: all rows, and distinct non-empty countries (0 if there is no such column)."""
    column = column or country_column(df)
    if column is None:
        countries = F.lit(0).cast("long")
    else:
        countries = F.count_distinct(F.when(col(column) != "", col(column)))
    return df.agg(F.count("*").alias("total"), countries.alias("countries"))


def _with_parent_names(df: DataFrame, entities: DataFrame) -> DataFrame:
    keys = [f"{kind}_parent_lei" for kind in ("direct", "ultimate")]
    hot = hot_keys(entities, *keys)
    for key in keys:
        name = key.replace("_lei", "_name")
        df = lookup(df, entities, key, "lei", "legal_name", name, hot=hot[key])
    return df


def entity_hierarchies(entities: DataFrame) -> DataFrame:
    """Names of the direct and the ultimate parent, for entities that have one."""
    children = entities.filter(
        (F.col("direct_parent_lei") != "") | (F.col("ultimate_parent_lei") != "")
    ).select("lei", "legal_name", "direct_parent_lei", "ultimate_parent_lei")
    return _with_parent_names(children, entities).drop("direct_parent_lei", "ultimate_parent_lei")


def entity_summary(entities: DataFrame) -> DataFrame:
    """Active entities with parent names, level in the hierarchy and region group."""
    direct, ultimate = F.col("direct_parent_lei"), F.col("ultimate_parent_lei")
    level = (
        F.when((direct == "") & (ultimate == ""), "Standalone")
        .when(ultimate == F.col("lei"), "Ultimate Parent")
        .when(direct != "", "Subsidiary")
        .otherwise("Unknown")
    )
    region = F
    for name, countries in REGION_GROUPS.items():
        region = region.when(F.col("country").isin(countries), name)
    return _with_parent_names(active_entities(entities), entities).withColumns(
        {"hierarchy_level": level, "region_group": region.otherwise(REGION_OTHER)}
    )


@dataclass(frozen=True)
class Model:
    name: str
    build: Callable[[DataFrame], DataFrame]
    source: str = "entities_rows"
    needs_country: bool = False

    @property
    def text(self) -> str:
        return inspect.getsource(self.build)


MODELS: dict[str, Model] = {
    m.name: m
    for m in (
        *(Model(f.__name__, f) for f in (active_entities, country_counts, entity_hierarchies, entity_summary)),
        *(Model(f.__name__, f, "bulk", True) for f in (country_counts_clean, dataset_stats)),
    )
}


def list_models() -> list[str]:
    return sorted(MODELS)


def model_text(name: str) -> str:
    return _model(name).text


def run_model(
    spark: SparkSession, name: str, source: str | None = None, target: str | None = None
) -> int:
    """Rebuild a model as a table and return its row count.

    Models of entities read the rows of the entity table, those of the bulk file the table it was loaded into, which
    must have a country column under one of its known names.
    """
    model = _model(name)
    rows = spark.table(source or model.source)
    if model.needs_country and country_column(rows) is None:
        raise LookupError(f"{source or model.source} has no country column")
    return replace_table(model.build(rows), target or name)


def _model(name: str) -> Model:
    if name not in MODELS:
        raise LookupError(f"no model {name!r}; there are {', '.join(list_models())}")
    return MODELS[name]
