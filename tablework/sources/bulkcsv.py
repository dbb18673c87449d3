"""The bulk CSV: every column as text, over-long rows left out, short rows padded."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.columns import col, null_to_empty, tokens_to_null
from tablework.operators.tables import replace_table
from tablework.schemas import NA_TOKENS
from tablework.sources import splitcsv

_EXTRA, _CORRUPT = "_extra", "_corrupt"

# A line that is one complete CSV record: fields without quotes, or fully quoted ones. Possessive, so
# that long lines need no backtracking.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_WHOLE_RECORD = rf"^{_FIELD}(?:,{_FIELD})*+\r?$"


def field_count(record: Column) -> Column:
    """How many fields a CSV record has. Separators inside quoted fields are no separators."""
    commas = F.length(record) - F.length(F.replace(record, F.lit(","), F.lit("")))
    bare = F.regexp_replace(record, r'(^|,)"[^"]*+(?:""[^"]*+)*+"', "$1")
    outside = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    return F.when(record.contains('"'), outside).otherwise(commas) + 1


@dataclass(frozen=True)
class Layout:
    """Files that are read alike: by the same columns, and by records that may be ``whole`` only over several lines."""

    header: tuple[str, ...]
    whole: bool


def _fields_of(line: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ()))


def file_layouts(spark: SparkSession, paths: str | list[str]) -> dict[Layout, list[str]]:
    """The files by layout, from one pass over their lines, split freely between tasks."""
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") == 0).alias("first_block"),
        F.monotonically_increasing_id().alias("place"),
    )
    first = F.min(F.when(F.col("first_block"), F.struct("place", "value")))
    broken = F.bool_or(~F.col("value").rlike(_WHOLE_RECORD))
    found: dict[Layout, list[str]] = {}
    for row in lines.groupBy("file").agg(first["value"].alias("header"), broken.alias("broken")).collect():
        layout = Layout(_fields_of(row["header"] or ""), row["broken"])
        found.setdefault(layout, []).append(unquote(row["file"]))
    return found


def header_of(spark: SparkSession, paths: str | list[str]) -> list[str]:
    return spark.read.option("header", True).option("escape", '"').csv(paths).columns


def files_with_line_breaks(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files in which some line is not a complete record, hence may sit inside a quoted field."""
    return sorted(f for layout, files in file_layouts(spark, paths).items() if layout.whole for f in files)


def _read(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in [*columns, _EXTRA, _CORRUPT]]
    )
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        # Whether a row is too long shows only if all of its fields are parsed.
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .csv(paths)
    )
    # The schema has one column more than the file. A row that fills it exactly is too long by one, and counts as
    # well-formed; a proper or a short row lacks the extra column, and counts as corrupt. So does a longer row whose
    # first extra field is empty: its separators tell.
    fits = F.col(_CORRUPT).isNotNull() & (field_count(F.col(_CORRUPT)) <= len(columns))
    return rows.filter(F.col(_EXTRA).isNull() & fits).select(*[col(c) for c in columns])


def parsed(records: DataFrame, header: Column, columns: list[str]) -> DataFrame:
    """Texts ``record`` as the text columns ``columns``, where ``header`` is the array of the names in their order.

    Over-long records are left out, short ones padded, empty fields are null.
    """
    fields = [f"_{i}" for i in range(len(columns))]
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    rows = records.filter((F.col("record") != "") & (field_count(F.col("record")) <= len(columns))).select(
        header.alias("header"), F.from_csv("record", ", ".join(f"{f} string" for f in fields), options).alias("row")
    )
    # Where a column stands may differ from file to file, so the fields are looked up by the header.
    values = F.array(*[F.col("row")[f] for f in fields])
    picked = [F.get(values, (F.array_position("header", c) - 1).cast("int")) for c in columns]
    return rows.select(*[F.nullif(v, F.lit("")).alias(c) for v, c in zip(picked, columns)])


def _read_records(spark: SparkSession, paths: str | list[str], header: list[str]) -> DataFrame:
    """Files with line breaks in quoted fields, each by as many tasks as it has splits."""
    rows = splitcsv.records(splitcsv.file_blocks(spark, paths)).filter(~F.col("first"))
    return parsed(rows, F.array(*map(F.lit, header)), header)


def read_text_csv(
    spark: SparkSession,
    paths: str | list[str],
    columns: list[str] | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Read CSV files as text columns: those of ``columns``, or of the first file by name.

    Every file's own header says which field is which; a file that has other columns is an error. ``multiline``
    says whether quoted fields may hold line breaks; by default it is found out file by file, in the pass that reads
    the headers. Files with such fields are put together from their splits by ``splitcsv``, all others are split by
    line. With ``columns`` and ``multiline`` given, that pass is left out and all files must have these columns in this
    order.
    """
    if columns is not None and multiline is not None:
        return (_read_records if multiline else _read)(spark, paths, columns)
    layouts = file_layouts(spark, paths)
    if not layouts:
        return _read(spark, paths, columns or header_of(spark, paths))
    if columns is None:
        columns = list(min(layouts.items(), key=lambda item: min(item[1]))[0].header)
    parts: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for layout, files in layouts.items():
        if sorted(layout.header) != sorted(columns):
            raise ValueError(f"{min(files)} has columns {list(layout.header)} instead of {columns}")
        whole = layout.whole if multiline is None else multiline
        parts.setdefault((layout.header, whole), []).extend(files)
    frames = [
        (_read_records if whole else _read)(spark, sorted(files), list(header)).select(*[col(c) for c in columns])
        for (header, whole), files in sorted(parts.items())
    ]
    return reduce(DataFrame.unionAll, frames)


def clean_text(df: DataFrame, na_tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Missing values as the empty text. With ``na_tokens=()`` texts such as ``NA`` stay as they are."""
    return null_to_empty(tokens_to_null(df, na_tokens))


def load_bulk(
    spark: SparkSession,
    paths: str | list[str],
    table: str,
    na_tokens: Iterable[str] = NA_TOKENS,
    multiline: bool | None = None,
    location: str | None = None,
) -> int:
    """Replace ``table`` by the cleaned content of the files; returns its row count."""
    rows = read_text_csv(spark, paths, multiline=multiline)
    return replace_table(clean_text(rows, na_tokens), table, location)
