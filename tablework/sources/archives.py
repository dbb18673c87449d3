"""ZIP archives: the rows of the first CSV member of each, by the rules of ``bulkcsv``."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.session import ship, stage
from tablework.sources import splitcsv
from tablework.sources.bulkcsv import parsed

# Characters of a part, which one task reads at a time.
PART = 4 << 20


def list_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The archives as rows ``(path, content)``; one task reads one archive at a time."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _open_member(content: bytes, path: str):
    archive = zipfile.ZipFile(io.BytesIO(content))
    member = next((n for n in archive.namelist() if n.endswith(".csv")), None)
    if member is None:
        raise ValueError(f"no CSV file in {path}")
    return archive.open(member)


def _parts(content: bytes, path: str) -> Iterator[str]:
    """The member as texts of whole lines, of about ``PART`` characters."""
    with _open_member(content, path) as member:
        held: list[str] = []
        size = 0
        for line in io.TextIOWrapper(member, "utf-8-sig", newline="\n"):
            held.append(line.removesuffix("\n"))
            size += len(line)
            if size >= PART:
                yield "\n".join(held)
                held, size = [], 0
        if held:
            yield "\n".join(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for number, text in enumerate(_parts(content, path)):
                columns = [pa.array([path]), pa.array([number], pa.int64()), pa.array([text])]
                yield pa.RecordBatch.from_arrays(columns, ["file", "start", "text"])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [next(csv.reader([record]), []) for record in batch.column("record").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(names, pa.list_(pa.string()))], ["of", "header"])


def read_archives(archives: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All rows of all archives as text columns; over-long rows are left out, short ones padded.

    Each archive's own header says which field is which; one with other columns fails the job. ``columns`` are those
    of the archive that comes first by path unless they are given. An archive is unpacked as a stream by one task, into
    parts in the shared folder; the parts are read by as many tasks as there are cores, by the rules of ``splitcsv``.
    ``archives`` has columns ``path`` and ``content``, see ``list_archives``.
    """
    ship(archives.sparkSession)
    parts = archives.select("path", "content").mapInArrow(_unpacked, "file string, start long, text string")
    found = splitcsv.records(stage(parts, "parts"))
    headers = found.filter("first").select("file", "record").mapInArrow(_headers, "of string, header array<string>")
    headers = stage(headers, "headers")
    if columns is None:
        first = headers.agg(F.min_by("header", "of").alias("header")).first()["header"]
        if first is None:
            raise ValueError("no archive found")
        columns = list(first)
    same = F.array_sort("header") == F.lit(sorted(columns))
    wrong = F.raise_error(F.concat(F.lit("an archive has columns "), F.array_join("header", ",")))
    rows = found.filter(~F.col("first")).join(headers, F.col("file") == F.col("of"))
    return parsed(rows.filter(F.when(same, True).otherwise(wrong.cast("boolean"))), F.col("header"), columns)
