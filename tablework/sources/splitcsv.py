"""The records of CSV files whose quoted fields may hold line breaks, each file read by many tasks.

Whether a line begins inside a quoted field depends on everything before it. So a block of a file is first read both ways,
as if it began outside and as if it began inside a field; what a block makes of either is one row. Going through these
rows in order settles for every block how it begins, and joins the records that reach from block to block. Then all blocks
are read once more, each on its own, for the records that lie within them.

Only a field that begins with a quote is quoted. Its end is the next quote that is not doubled; what follows up to the
separator belongs to the field, and does not begin another one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.session import ship, stage

_REST_OF_QUOTED = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_READ = (
    "file string, start long, records long, open_outside boolean, tail_outside string, head_inside string, "
    "closed_inside boolean, open_inside boolean, tail_inside string"
)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one, or outside."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            rest = _REST_OF_QUOTED.match(line, at if inside else at + 1)
            if rest is None:
                return True
            at, inside = rest.end(), False
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


class _Reading:
    """The records of one block for one way of beginning: the lines before its first record, and after its last one."""

    def __init__(self, inside: bool):
        self.inside = inside
        self.head: list[str] | None = [] if inside else None
        self.open: list[str] = []
        self.records = 0

    def line(self, text: str, quotes: bool) -> str | None:
        """The record that this line completes, unless it is the one that began before the block."""
        if quotes:
            self.inside = ends_inside(text, self.inside)
        if self.head is not None:
            self.head.append(text)
            if not self.inside:
                self.whole_head, self.head = "\n".join(self.head), None
            return None
        self.open.append(text)
        if self.inside:
            return None
        record = "\n".join(self.open)
        self.open.clear()
        self.records += 1
        return record

    def plain(self, lines: int) -> bool:
        """Pass over lines without quotes if each of them is a record."""
        if self.inside:
            return False
        self.records += lines
        return True


def _lines(column: pa.Array) -> tuple[list[str], list[bool]]:
    """All lines of texts of whole lines, and which of them have quotes."""
    lines = [line for text in column.to_pylist() for line in text.split("\n")]
    return lines, ['"' in line for line in lines]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of rows of one block."""
    files, starts = batch.column("file"), batch.column("start")
    if not len(batch):
        return
    same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(starts[1:], starts[:-1]))
    cuts = [0, *(i + 1 for i, s in enumerate(same.to_pylist()) if not s), len(batch)]
    for begin, end in zip(cuts, cuts[1:]):
        yield files[begin].as_py(), starts[begin].as_py(), batch.slice(begin, end - begin)


def _read_both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, outside, inside = None, None, None

    def row() -> pa.RecordBatch:
        closed = inside.head is None
        values = [
            *key,
            outside.records,
            outside.inside,
            "\n".join(outside.open) if outside.inside else None,
            inside.whole_head if closed else "\n".join(inside.head),
            closed,
            inside.inside,
            "\n".join(inside.open) if closed and inside.inside else None,
        ]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
        names = [f.split()[0] for f in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for file, start, run in _runs(batch):
            if (file, start) != key:
                if key is not None:
                    yield row()
                key, outside, inside = (file, start), _Reading(False), _Reading(True)
            lines, quotes = _lines(run.column("text"))
            for reading in (outside, inside):
                if any(quotes) or not reading.plain(len(lines)):
                    for line, quoted in zip(lines, quotes):
                        reading.line(line, quoted)
    if key is not None:
        yield row()


def _settled(key, blocks):
    """The blocks of a file that begin inside a field, and the records that reach over a border."""
    out, held, first = [], None, False
    for b in sorted(blocks.to_pylist(), key=lambda b: b["start"]):
        if held is None:
            if b["open_outside"]:
                held, first = [b["tail_outside"]], not out and b["start"] == 0 and b["records"] == 0
            continue
        out.append((b["file"], b["start"], None, False))
        held.append(b["head_inside"])
        if b["closed_inside"]:
            out.append((b["file"], None, "\n".join(held), first))
            held, first = [b["tail_inside"]] if b["open_inside"] else None, False
    if held is not None:
        out.append((key[0].as_py(), None, "\n".join(held), first))
    columns = list(zip(*out)) if out else [()] * 4
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "record", "first"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, reading = None, None
    for batch in batches:
        for file, start, run in _runs(batch):
            if (file, start) != key:
                key, reading = (file, start), _Reading(bool(run.column("inside")[0].as_py()))
            before = reading.records
            lines, quotes = _lines(run.column("text"))
            if any(quotes) or not reading.plain(len(lines)):
                found = [reading.line(line, quoted) for line, quoted in zip(lines, quotes)]
                lines = [record for record in found if record is not None]
            first = [start == 0 and before == 0 and i == 0 for i in range(len(lines))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(lines), pa.string()), pa.array(lines, pa.string()), pa.array(first, pa.bool_())],
                ["file", "record", "first"],
            )


def records(blocks: DataFrame) -> DataFrame:
    """``file, record, first`` of ``blocks``: rows ``file, start, text``, the rows of a block in order within one task.

    A text is one or more whole lines without the last line end, a block some lines of a file, ``start`` its place among
    the blocks, 0 for the first. ``first`` marks the first record of a file. A field that is never closed ends with its
    file. An empty line is an empty record. One row per block goes through one task per file, and those that begin
    inside a field are broadcast: a row for each 128 MB of input, at Spark's default.
    """
    ship(blocks.sparkSession)
    read = blocks.mapInArrow(_read_both_ways, _READ)
    settled = read.groupBy("file").applyInArrow(_settled, "file string, start long, record string, first boolean")
    settled = stage(settled, "borders")
    inside = settled.filter(F.col("start").isNotNull()).select(
        F.col("file").alias("of"), F.col("start").alias("at"), F.lit(True).alias("inside")
    )
    # A broadcast join leaves the lines in their order.
    begun = blocks.join(F.broadcast(inside), (F.col("file") == F.col("of")) & (F.col("start") == F.col("at")), "left")
    own = begun.select("file", "start", "text", "inside").mapInArrow(_within, "file string, record string, first boolean")
    across = settled.filter(F.col("record").isNotNull()).select("file", "record", "first")
    return own.unionByName(across).withColumn("record", F.regexp_replace("record", "\r$", ""))


def file_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines of files in the splits that Spark reads them by."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("text"),
    )
