"""Choosing, quoting and cleaning columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.schemas import NA_TOKENS


def quoted(name: str) -> str:
    """Back-quote one identifier, so that dots and odd characters in it stay literal."""
    return "`" + name.replace("`", "``") + "`"


def quoted_table(name: str) -> str:
    """Back-quote each part of a possibly qualified table name."""
    return ".".join(quoted(part.strip("`")) for part in name.split("."))


def col(name: str) -> Column:
    return F.col(quoted(name))


def pick_column(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first of ``candidates`` that exists, or None."""
    present = set(columns)
    return next((c for c in candidates if c in present), None)


def find_column(columns: Iterable[str], matches: Callable[[str], bool]) -> str | None:
    """The first column whose name satisfies ``matches``, or None."""
    return next(filter(matches, columns), None)


def is_key_column(name: str) -> bool:
    upper = name.upper()
    return "LEI" in upper and "PARENT" not in upper


def is_name_column(name: str) -> bool:
    return any(part in name for part in ("LegalName", "Legal.Name"))


def _text_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}


def tokens_to_null(df: DataFrame, na_tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Turn the texts that stand for "missing" into null, in every text column."""
    tokens = list(na_tokens)
    if not tokens:
        return df
    text = _text_columns(df)
    return df.select(
        *[
            F.when(~col(c).isin(tokens), col(c)).alias(c) if c in text else col(c)
            for c in df.columns
        ]
    )


def null_to_empty(df: DataFrame) -> DataFrame:
    """Turn null into the empty text, in every text column."""
    text = _text_columns(df)
    return df.select(
        *[
            F.coalesce(col(c), F.lit("")).alias(c) if c in text else col(c)
            for c in df.columns
        ]
    )


def not_blank(column: Column) -> Column:
    return column.isNotNull() & (column != "")
