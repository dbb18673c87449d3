"""What the operators of this package share: clean inputs, row identity, size-checked joins, bytes in numpy."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.session import ship, stage

# A side is broadcast only if it was staged and has at most so many rows and bytes on disk; else the join is shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20
# Text that one numpy pass works on at a time. A longer document makes a pass of its own.
SLICE_BYTES = 1 << 20
# Rows and bytes of an Arrow batch, so that the text of one batch stays small in a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

SPACE = r"[\x20\x09-\x0D]"


def ready(spark: SparkSession) -> None:
    """Settings that the operators rely on; the package goes to the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text being empty; other columns cannot clash with an operator's own."""
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    return df.select(col(id_column).alias("doc_id"), text.alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str, label: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder with a number for each row, by which equal rows can be told apart.

    The numbers hold because they are read from the written table, never computed again.
    """
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label, **options)


def identified(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` with a number for each row, always the same one for the same row.

    Rows that are read from Parquet files as they are get the number of their file and their place in it, and only the
    list of files is written. Anything else is written first, as ``numbered`` does.
    """
    if not _reads_rows(df._jdf.queryExecution().analyzed()):
        return numbered(df, name, label)
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return numbered(df, name, label)
    # One row per file, so one task can rank them.
    files = placed.select("_file").distinct()
    files = stage(files.withColumn("_base", F.row_number().over(Window.orderBy("_file")).cast("long")), "files")
    number = F.shiftleft("_base", 40) + F.col("_at")
    return placed.join(sized(files), "_file").withColumn(name, number).drop("_file", "_at", "_base")


def _reads_rows(plan) -> bool:
    """Whether an analysed plan is a scan of files below projections and filters alone."""
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().apply(0)
    return "Relation" in plan.nodeName()


def let_go(spark: SparkSession) -> None:
    """Have the driver forget finished steps, so that Spark's cleaner removes their shuffle files.

    It does so for whatever the driver's collector has found unused, which may otherwise take half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(side: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A staged ``side``, marked for broadcast if its files and rows are within the bounds."""
    return F.broadcast(side) if fits(side, most) else side


def fits(side: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the files and rows of a staged ``side`` are within the bounds of a broadcast."""
    return bytes_of(side) <= most and side.count() <= BROADCAST_ROWS


def few(staged: DataFrame) -> DataFrame:
    """A staged frame in one partition if it could as well be broadcast, so that its next steps need no shuffle."""
    return staged.coalesce(1) if fits(staged) else staged


def bytes_of(staged: DataFrame) -> int:
    """Bytes on disk of a staged frame, from one summary of its folder."""
    context = staged.sparkSession.sparkContext
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def without(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """The rows of ``rows`` whose number is not in ``dropped``."""
    side = sized(stage(dropped.select(name), "dropped"))
    return rows.join(side, name, "left_anti").drop(name)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- text as bytes ----------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words of letters and digits: every byte of a character beyond ASCII belongs to one.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
# Words between white space.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


# What a worker remembers from task to task, of one operator at a time.
_remembered: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave the worker for ``key``, until a task asks for another key or reads texts without ``keep``."""
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, keep: bool = False
) -> Iterator[tuple]:
    """``(batch, data, offsets)`` for runs of rows of up to ``most`` bytes of text, or one longer row.

    ``data`` are the bytes of the run's texts one after the other; row ``i`` has ``data[offsets[i]:offsets[i + 1]]``.
    Unless the task is to ``keep`` it, the worker lets go of what an operator before remembered: workers are used again,
    so the operators of a pipeline would hold their memory side by side.
    """
    if not keep:
        _remembered.clear()
    yield from _slices(batches, text, most)
    # Arrow holds on to memory of batches that are gone.
    pa.default_memory_pool().release_unused()


def _slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        rows = len(column)
        if not rows:
            continue
        _, places, body = column.buffers()
        offsets = np.frombuffer(places, kind, rows + 1 + column.offset)[column.offset :]
        offsets = offsets.astype(np.int64)
        data = np.frombuffer(body or b"", np.uint8)
        begin = 0
        while begin < rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
            end = min(rows, max(end, begin + 1))
            part = offsets[begin : end + 1]
            yield batch.slice(begin, end - begin), data[part[0] : part[-1]], part - part[0]
            begin = end


def word_spans(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word reaches from one row into the next."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside[:-1]
    after = inside[1:].copy()
    borders = offsets[1:-1]
    before[borders] = False
    after[borders[borders > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside[:-1] & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the value."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and which of them each value is. Only the different ones are sorted."""
    held = pa.array(values).dictionary_encode()
    found, which = held.dictionary.to_numpy(), held.indices.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[which]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    """``base ** i`` modulo 2 ** 64 for all ``i`` below ``count``."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[:count]


class Spans:
    """Hashes of any spans of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power(_BASE, len(values)), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _power(_INVERSE, len(self.sums))
        return mixed((self.sums[ends] - self.sums[starts]) * back[starts])


def byte_spans(data: np.ndarray) -> Spans:
    return Spans(_BYTE_VALUES[data])
