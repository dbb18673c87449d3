"""Incremental loads: what has landed since the last run, applied exactly once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablework.functions.columns import col, quoted, quoted_table
from tablework.functions.rows import with_load_time
from tablework.operators.tables import add_batch, fits_as_is, key_of, latest_per_key, overwrite_partitions
from tablework.schemas import LOAD_TIME_COLUMN, UPDATE_COLUMN
from tablework.session import discard, stage
from tablework.sources.records import entities_of

BATCH = "_batch"

# A backlog is worked off in batches of this many files, each committed on its own.
FILES_PER_BATCH = 10_000

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def landed_pages(
    spark: SparkSession,
    path: str,
    whole_files: bool = True,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Stream of landed pages, one row ``body`` per file, or per line if not ``whole_files``."""
    return (
        spark.readStream.format("text")
        .option("wholetext", whole_files)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select(F.col("value").alias("body"))
    )


def landed_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    format: str,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Stream of landed data files of a known schema."""
    return (
        spark.readStream.format(format)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def upsert_stream(
    rows: DataFrame,
    table: str,
    checkpoint: str,
    quarantine: str | None = None,
    dedupe_by: str | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch into a keyed table, and stop when all that has landed is in.

    A batch that is repeated after a failure gives the same rows, because upserts are keyed. That does not hold
    for rows without a key: they go to the folder ``quarantine``, one subfolder per batch, or, without such a
    folder, fail the query. With ``dedupe_by`` the greatest row of a key by that column wins, whatever micro-batch or
    order its versions come in. Without it, the rows of a key are those of the last micro-batch that has it.

    With ``dedupe_by``, and rows of the table's own types, the stream keeps the greatest row of each key in its state
    store: a micro-batch is combined by key before its shuffle, and what comes out of it are the winners of its keys.
    The table is not read for that, as long as this stream alone has written it; if others have as well, the keys of
    the batch are looked up in it. A key that somebody deletes comes back, with its greatest row, when it lands again.
    """
    spark = rows.sparkSession
    key = key_of(spark, table)
    stateful = dedupe_by is not None and fits_as_is(rows, table)
    writer = hashlib.md5(checkpoint.encode()).hexdigest() if stateful else ""

    def apply(batch: DataFrame, number: int) -> None:
        batch = stage(batch, "microbatch")
        if quarantine:
            lost = batch.filter(col(key).isNull())
            lost.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        rows = batch.filter(col(key).isNotNull()) if quarantine else batch
        add_batch(rows, table, dedupe_by=dedupe_by, staged=True, writer=writer)
        discard(batch)

    if stateful:
        return _run(latest_per_key(rows, key, dedupe_by), apply, table, checkpoint, "update")
    return _run(rows, apply, table, checkpoint)


def upsert_entities(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    quarantine: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """New landed pages into the entity table, with the time of loading. The latest update of an entity wins."""
    bodies = landed_pages(spark, path, files_per_batch=files_per_batch)
    rows = with_load_time(entities_of(bodies), LOAD_TIME_COLUMN)
    return upsert_stream(rows, table, checkpoint, quarantine, UPDATE_COLUMN)


def create_append_table(
    spark: SparkSession, table: str, schema: T.StructType, path: str | None = None
) -> None:
    """A table for ``append_stream``: every micro-batch is a partition."""
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    location = f"LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted_table(table)} ({columns}, {BATCH} string) "
        f"USING parquet PARTITIONED BY ({BATCH}) {location}"
    )


def append_stream(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch to a table made by ``create_append_table``.

    A batch that is repeated after a failure replaces its own partition, so no row is added twice.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def apply(batch: DataFrame, number: int) -> None:
        named = batch.withColumn(BATCH, F.lit(f"{run}-{number}"))
        overwrite_partitions(named, table)

    return _run(rows, apply, table, checkpoint)


def _run(
    rows: DataFrame, apply: Callable[[DataFrame, int], None], table: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    spark = rows.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        apply(batch, number)
        # The stream writes in a session of its own; let the caller's session list the files anew.
        spark.catalog.refreshTable(table)

    with _state_on_disk(spark):
        return (
            rows.writeStream.foreachBatch(step)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, not in the memory of executors."""
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_PROVIDER, before)
