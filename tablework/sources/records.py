"""Nested JSON documents as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.schemas import RECORD_PATHS


def path_text(record: Column, path: str) -> Column:
    """Text at a path of a variant: ``''`` where the path is missing, null where it holds null."""
    found = F.variant_get(record, path, "variant")
    return F.when(~F.is_variant_null(found) | found.isNull(), F.coalesce(found.cast("string"), F.lit("")))


def json_text(document: Column, path: str) -> Column:
    """``path_text`` on JSON text."""
    return path_text(F.parse_json(document), path)


def explode_records(documents: DataFrame, body: str = "body", path: str = "$.data") -> DataFrame:
    """One row ``record`` per element of the array at ``path`` of each JSON document."""
    return (
        documents.select(F.parse_json(col(body)).alias("_document"))
        .select(F.variant_get("_document", path, "variant").alias("_array"))
        .lateralJoin(
            documents.sparkSession.tvf.variant_explode(F.col("_array").outer()).select(
                F.col("value").alias("record")
            )
        )
        .select("record")
    )


def flatten(records: DataFrame, paths: dict[str, str] | None = None) -> DataFrame:
    """One text column per entry of ``paths``, from a frame with a variant column ``record``."""
    record = F.col("record")
    return records.select(
        *[path_text(record, p).alias(name) for name, p in (paths or RECORD_PATHS).items()]
    )


def entities_of(pages: DataFrame, body: str = "body") -> DataFrame:
    """The entity rows of landed pages."""
    return flatten(explode_records(pages, body))
