"""Reading files as frames, by format or by file name."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.sources.bulkcsv import file_layouts


def read_csv(
    spark: SparkSession, path: str | list[str], multiline: bool | None = None
) -> DataFrame:
    """CSV with a header line; types are inferred from all rows.

    Files can be split between tasks unless quoted fields hold line breaks; by default that is found out.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if multiline is None:
        kinds: dict[bool, list[str]] = {}
        for layout, files in file_layouts(spark, path).items():
            kinds.setdefault(layout.whole, []).extend(files)
        if len(kinds) == 2:
            # The types are found over all files; then each kind of file is read in its own way.
            schema = reader.option("inferSchema", True).option("multiLine", True).csv(path).schema
            reader = reader.schema(schema).option("enforceSchema", False)
            parts = [reader.option("multiLine", whole).csv(files) for whole, files in kinds.items()]
            return parts[0].unionByName(parts[1])
        multiline = True in kinds
    return reader.option("inferSchema", True).option("multiLine", multiline).csv(path)


def json_layouts(spark: SparkSession, path: str | list[str]) -> dict[bool, list[str]]:
    """The files by whether they are read whole, having something else than an object per line."""
    line = F.trim(F.col("value"))
    odd = (line != "") & ~(line.startswith("{") & line.endswith("}"))
    lines = spark.read.text(path).select(odd.alias("odd"), F.col("_metadata.file_path").alias("file"))
    found: dict[bool, list[str]] = {}
    for row in lines.groupBy("file").agg(F.bool_or("odd").alias("whole")).collect():
        found.setdefault(row["whole"], []).append(unquote(row["file"]))
    return found


def merged_type(one: T.DataType, two: T.DataType) -> T.DataType:
    """The type that inferred values of both types have together; what does not fit is text."""
    if one == two or isinstance(two, T.NullType):
        return one
    if isinstance(one, T.NullType):
        return two
    if isinstance(one, T.StructType) and isinstance(two, T.StructType):
        fields = {f.name: f.dataType for f in one}
        for f in two:
            fields[f.name] = merged_type(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(name, fields[name]) for name in sorted(fields)])
    if isinstance(one, T.ArrayType) and isinstance(two, T.ArrayType):
        return T.ArrayType(merged_type(one.elementType, two.elementType))
    if isinstance(one, T.NumericType) and isinstance(two, T.NumericType):
        whole = isinstance(one, T.IntegralType) and isinstance(two, T.IntegralType)
        return T.LongType() if whole else T.DoubleType()
    return T.StringType()


def read_json(
    spark: SparkSession, path: str | list[str], multiline: bool | None = None
) -> DataFrame:
    """JSON with inferred types: one object per line, or one array or object per file, in any mixture.

    Files with an object per line can be split between tasks; by default it is found out file by file which they are.
    """
    kinds = {} if multiline is not None else json_layouts(spark, path)
    if len(kinds) < 2:
        return spark.read.option("multiLine", next(iter(kinds), bool(multiline))).json(path)
    # The types are those of all files together; then each kind of file is read in its own way.
    readers = {whole: spark.read.option("multiLine", whole) for whole in kinds}
    schema = merged_type(*[readers[whole].json(files).schema for whole, files in kinds.items()])
    parts = [readers[whole].schema(schema).json(files) for whole, files in kinds.items()]
    return parts[0].unionByName(parts[1])


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


Reader = Callable[[SparkSession, str], DataFrame]


READERS: dict[str, Reader] = {
    ".csv": read_csv,
    ".json": read_json,
    ".parquet": read_parquet,
}


def reader_for(name: str) -> Reader:
    """The reader for a file name; the extension is matched case-sensitively."""
    for extension, reader in READERS.items():
        if name.endswith(extension):
            return reader
    raise ValueError(f"unsupported file format: {name}")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Read a file in the format its name says; other names are an error."""
    return reader_for(path)(spark, path)


def read_file_or_parquet(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_file``, but any other name is taken for Parquet."""
    try:
        reader = reader_for(path)
    except ValueError:
        reader = read_parquet
    return reader(spark, path)
