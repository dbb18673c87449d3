"""Whole rows as text: concatenation, JSON and labels."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.columns import col

_JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
}


def combined_text(columns: list[str], null_text: str = "") -> Column:
    """The chosen columns as text, joined by ``' | '``; a null counts as ``null_text``."""
    if not columns:
        raise ValueError("choose at least one text column")
    return F.concat_ws(
        " | ", *[F.coalesce(col(c).cast("string"), F.lit(null_text)) for c in columns]
    )


def row_json(columns: list[str]) -> Column:
    """One row as a JSON object: nulls kept, timestamps in ISO form with milliseconds."""
    return F.to_json(F.struct(*[col(c) for c in columns]), _JSON_OPTIONS)


@F.arrow_udf(T.StringType())
def pretty_json(compact: pa.Array) -> pa.Array:
    """Indented JSON, two blanks per level. Meant for the few rows that end up in an answer."""
    return pa.array(
        [None if t is None else json.dumps(json.loads(t), indent=2) for t in compact.to_pylist()],
        pa.string(),
    )


def match_label(similarity: Column) -> Column:
    """``0.8731`` becomes ``87.3% match``."""
    return F.format_string("%.1f%% match", similarity * 100)


def with_load_time(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.localtimestamp())
