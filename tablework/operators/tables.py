"""Writing tables: create, append, replace, keyed upsert, views."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.columns import col, quoted, quoted_table
from tablework.operators.skew import salted_join
from tablework.schemas import ENTITY_SCHEMA
from tablework.session import discard, stage

VERSION = "_version"
_KEY_PROPERTY = "tablework.key"
_HISTORY_PROPERTY = "tablework.history"
_LOSSY = "_lossy"
# Later versions are merged into the base when they have more than this share of its rows.
COMPACT_SHARE = 0.25


# ---- plain tables ---------------------------------------------------------------------------


def create_if_absent(df: DataFrame, table: str, path: str | None = None) -> int:
    """Create ``table`` from ``df`` unless it exists; the table's row count either way."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        _save(df, table, "ignore", path)
    return spark.table(table).count()


def create_empty_like(df: DataFrame, table: str, path: str | None = None) -> None:
    """Create ``table`` without rows and with the columns of ``df``, unless it exists."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        _save(spark.createDataFrame([], df.schema), table, "ignore", path)


def append_rows(target: DataFrame, rows: DataFrame, by: str = "position") -> DataFrame:
    """All rows of both frames; columns are matched by position, or by name if asked."""
    if by == "name":
        return target.unionByName(rows)
    return target.union(rows)


def append_table(rows: DataFrame, table: str, by: str = "position") -> int:
    """Append to an existing table and return how many rows were added."""
    if by == "name":
        rows = rows.select(*[col(c) for c in rows.sparkSession.table(table).columns])
    rows, counter = _counted(rows)
    rows.write.insertInto(table)
    return counter.get["rows"]


def replace_table(df: DataFrame, table: str, path: str | None = None) -> int:
    """Replace the whole table, check that every row arrived, and return the count.

    ``path`` puts a new table somewhere else than into the warehouse folder.
    """
    spark = df.sparkSession
    df, counter = _counted(df)
    _save(df, table, "overwrite", path)
    written, found = counter.get["rows"], spark.table(table).count()
    if written != found:
        raise RuntimeError(f"{table} has {found} rows, {written} were written")
    return found


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table, and the view over it if it is a keyed one."""
    if spark.catalog.tableExists(table):
        properties = {r["key"] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted_table(table)}").collect()}
        if _KEY_PROPERTY in properties:
            spark.sql(f"DROP VIEW IF EXISTS {quoted_table(rows_view(table))}")
    spark.sql(f"DROP TABLE IF EXISTS {quoted_table(table)}")


def create_view(spark: SparkSession, name: str, query: str) -> None:
    """Create or replace a view that is stored in the catalog."""
    spark.sql(f"CREATE OR REPLACE VIEW {quoted_table(name)} AS {query}")


def register(df: DataFrame, name: str) -> None:
    """Make a frame visible to SQL under a name, for this session."""
    df.createOrReplaceTempView(name)


def unregister(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def _save(df: DataFrame, table: str, mode: str, path: str | None) -> None:
    writer = df.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    counter = Observation()
    return df.observe(counter, F.count(F.lit(1)).alias("rows")), counter


# ---- keyed tables ---------------------------------------------------------------------------
#
# A keyed table is a Parquet table of versions and a view over it that shows its rows. An upsert adds the batch as a
# version and then changes the view; nothing that is there is rewritten, and a batch that fails on the way was never
# visible. The view takes the base version, without the keys of later ones, and the newest version of each later key.
# When the later versions have grown to ``COMPACT_SHARE`` of the base, they become one new base. Version -n holds the keys
# that version n removed, with nulls in the other columns. A table with history keeps the versions before its base.


def create_keyed_table(
    spark: SparkSession, table: str, schema: T.StructType, key: str, path: str | None = None, history: bool = False
) -> None:
    """An empty table for ``upsert``, unless it exists. ``keyed_rows`` and the view ``<table>_rows`` show its rows.

    With ``history`` compaction keeps the versions before it, for ``operators.changes``, until ``forget`` drops them.
    """
    if spark.catalog.tableExists(table):
        return
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    location = f"LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE {quoted_table(table)} ({columns}, {VERSION} bigint) "
        f"USING parquet PARTITIONED BY ({VERSION}) {location} "
        f"TBLPROPERTIES ('{_KEY_PROPERTY}'='{key}', '{_HISTORY_PROPERTY}'='{str(history).lower()}')"
    )
    _commit(spark, table, _State(key))


def create_entity_table(spark: SparkSession, table: str = "entities", path: str | None = None) -> None:
    create_keyed_table(spark, table, ENTITY_SCHEMA, "lei", path)


def rows_view(table: str) -> str:
    """The name of the view that shows the rows of a keyed table."""
    return f"{table}_rows"


def keyed_rows(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a keyed table, as of the last upsert that ended."""
    # Another session, such as that of a stream, may have written since this one listed the files.
    spark.catalog.refreshTable(table)
    return spark.table(rows_view(table))


@dataclass(frozen=True)
class _State:
    """What the view shows: the base version, the last version, and how many rows each side has; then the oldest version
    that can still be read, which versions are compactions and so change nothing, and the stream that wrote all versions
    so far, if it was one."""

    key: str
    base: int = 0
    last: int = 0
    base_rows: int = 0
    later_rows: int = 0
    oldest: int = 0
    compacted: tuple[int, ...] = ()
    writer: str = ""

    def base_at(self, version: int) -> int:
        """The version that the rows of ``version`` are based on."""
        return max((n for n in self.compacted if n <= version), default=min(version, 1))


_NUMBERS = ("base", "last", "base_rows", "later_rows", "oldest")


def _state(spark: SparkSession, table: str) -> _State:
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted_table(table)}").collect()
    properties = {r["key"]: r["value"] for r in rows}
    if _KEY_PROPERTY not in properties:
        raise LookupError(f"{table} is not a keyed table")
    numbers = spark.sql(f"SHOW TBLPROPERTIES {quoted_table(rows_view(table))}").collect()
    found = {r["key"]: r["value"] for r in numbers}
    return _State(
        properties[_KEY_PROPERTY],
        *(int(found[f"tablework.{f}"]) for f in _NUMBERS),
        tuple(int(n) for n in found["tablework.compacted"].split(",") if n),
        found.get("tablework.writer", ""),
    )


def _rows_query(spark: SparkSession, table: str, key: str, base: int, last: int) -> str:
    """SQL of the rows as of version ``last``, which is based on version ``base``."""
    columns = [c for c in spark.table(table).columns if c != VERSION]
    names, key, source = ", ".join(map(quoted, columns)), quoted(key), quoted_table(table)
    query = f"SELECT {names} FROM {source} WHERE {VERSION} = {base}"
    if last > base:
        later = f"FROM {source} WHERE {versions_between(base, last)}"
        query = (
            f"SELECT {names} FROM {source} b WHERE {VERSION} = {base} AND NOT EXISTS (SELECT 1 FROM "
            f"(SELECT DISTINCT {key} AS changed {later}) WHERE changed = b.{key}) "
            f"UNION ALL SELECT {names} FROM (SELECT *, max(abs({VERSION})) OVER (PARTITION BY {key}) AS newest {later} "
            f"AND {key} IS NOT NULL) WHERE {VERSION} = newest "
            f"UNION ALL SELECT {names} {later} AND {key} IS NULL"
        )
    return query


def versions_between(after: int, upto: int) -> str:
    """A condition that finds what the versions later than ``after`` wrote and removed, up to ``upto``."""
    return f"({VERSION} > {after} AND {VERSION} <= {upto} OR {VERSION} < {-after} AND {VERSION} >= {-upto})"


def _commit(spark: SparkSession, table: str, state: _State) -> None:
    """One statement: the view shows the new state, and carries its numbers."""
    query = _rows_query(spark, table, state.key, state.base, state.last)
    numbers = [f"'tablework.{f}'='{getattr(state, f)}'" for f in _NUMBERS]
    numbers.append(f"'tablework.compacted'='{','.join(map(str, state.compacted))}'")
    numbers.append(f"'tablework.writer'='{state.writer}'")
    view = quoted_table(rows_view(table))
    spark.sql(f"CREATE OR REPLACE VIEW {view} TBLPROPERTIES ({', '.join(numbers)}) AS {query}")


def _write_version(rows: DataFrame, table: str, version: int, removed: DataFrame | None = None) -> int:
    """Write a version and return how many rows it has, removed keys included, which their files tell."""
    spark = rows.sparkSession
    # A version that failed before its commit may have left more partitions than this one overwrites.
    for number in (version, -version):
        spark.sql(f"ALTER TABLE {quoted_table(table)} DROP IF EXISTS PARTITION ({VERSION}={number}) PURGE")
    fields = [f for f in spark.table(table).schema.fields if f.name != VERSION]
    rows = rows.select(*[col(f.name) for f in fields], F.lit(version).cast("bigint").alias(VERSION))
    if removed is not None:
        kept = set(removed.columns)
        blank = [(col(f.name) if f.name in kept else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
        rows = rows.union(removed.select(*blank, F.lit(-version).cast("bigint").alias(VERSION)))
    overwrite_partitions(rows, table)
    spark.catalog.refreshTable(table)
    return spark.table(table).filter(F.col(VERSION).isin(version, -version)).count()


def _add_version(
    spark: SparkSession, table: str, state: _State, rows: DataFrame, removed: DataFrame | None = None, writer: str = ""
) -> int:
    """Write the next version, show it, and compact if it is time; the number of the version."""
    version = state.last + 1
    written = _write_version(rows, table, version, removed)
    if state.last == 0:
        state = replace(state, base=1, last=1, base_rows=written, writer=writer)
    else:
        writer = writer if writer == state.writer else ""
        state = replace(state, last=version, later_rows=state.later_rows + written, writer=writer)
    _commit(spark, table, state)
    if state.later_rows > COMPACT_SHARE * state.base_rows:
        compact(spark, table)
    return version


def compact(spark: SparkSession, table: str) -> None:
    """Make what the view shows the new base, and remove the versions before it once the view has changed, unless the
    table has history."""
    state = _state(spark, table)
    version = state.last + 1
    written = _write_version(keyed_rows(spark, table), table, version)
    compacted = (*state.compacted, version)
    _commit(spark, table, _State(state.key, version, version, written, 0, state.oldest, compacted, state.writer))
    if not _has_history(spark, table):
        forget(spark, table, version)


def _has_history(spark: SparkSession, table: str) -> bool:
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted_table(table)}").collect()
    return {r["key"]: r["value"] for r in rows}.get(_HISTORY_PROPERTY) == "true"


def forget(spark: SparkSession, table: str, before: int) -> None:
    """Drop what only versions older than ``before`` need; these can no longer be read or compared."""
    state = _state(spark, table)
    if before > state.last:
        raise ValueError(f"{table} has no version {before}")
    if before <= state.oldest:
        return
    base = state.base_at(before)
    _commit(spark, table, replace(state, oldest=before, compacted=tuple(n for n in state.compacted if n >= base)))
    for row in spark.sql(f"SHOW PARTITIONS {quoted_table(table)}").collect():
        if abs(int(row[0].split("=")[1])) < base:
            spark.sql(f"ALTER TABLE {quoted_table(table)} DROP PARTITION ({row[0]}) PURGE")


def _as_in_table(batch: DataFrame, table: str) -> tuple[DataFrame, Column]:
    """The batch in the table's columns and types, and a condition that finds rows that lose something by it."""
    fields = [f for f in batch.sparkSession.table(table).schema.fields if f.name != VERSION]
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    lossy, columns = F.lit(False), []
    for f in fields:
        if kinds[f.name] == f.dataType:
            columns.append(col(f.name))
            continue
        cast = col(f.name).try_cast(f.dataType)
        same = cast.try_cast(kinds[f.name]).eqNullSafe(col(f.name))
        lossy = lossy | ~same
        columns.append(cast.alias(f.name))
    return batch.select(*columns, lossy.alias(_LOSSY)), F.col(_LOSSY)


def upsert_rows(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``target`` without the keys of ``batch``, plus every row of ``batch``.

    Null keys match nothing, so null-key rows of the target stay. Keys repeated in the batch are
    all kept; see ``latest_per_key``.
    """
    keys = batch.select(col(key).alias("_batch_key")).distinct()
    kept = salted_join(target, keys, key, "_batch_key", "left_anti")
    return kept.unionByName(batch)


def latest_per_key(batch: DataFrame, key: str, order_by: str) -> DataFrame:
    """One row per key, the one with the greatest ``order_by``; rows without a key all stay.

    An aggregate, not a window: rows of a frequent key are combined before the shuffle.
    """
    rest = [c for c in batch.columns if c not in (key, order_by)]
    row = F.struct(col(order_by), *[col(c) for c in rest])
    best = (
        batch.filter(col(key).isNotNull())
        .groupBy(col(key).alias("_key"))
        .agg(F.max(row).alias("_row"))
        .select(
            *[
                (F.col("_key") if c == key else F.col("_row")[c]).alias(c)
                for c in batch.columns
            ]
        )
    )
    return best.unionByName(batch.filter(col(key).isNull()))


def upsert(
    batch: DataFrame,
    table: str,
    null_keys: str = "error",
    dedupe_by: str | None = None,
    staged: bool = False,
) -> int:
    """Apply ``batch`` to a keyed table and return the table's row count.

    The batch is cast to the table's types; values that do not survive that are an error. It becomes a version of the
    table of its own, so the work is in proportion to the batch. Applying the same batch again gives the same rows,
    as long as no key is null: such rows match nothing and would be added again. They are an error unless ``null_keys``
    is ``keep``. With ``dedupe_by`` a key's greatest row by that column wins, over rows of the batch and over the row
    that the table has. One writer at a time. ``staged`` says that the batch is cheap to read again, so that it is not
    written out first.
    """
    if null_keys not in ("error", "keep"):
        raise ValueError("null_keys must be error or keep")
    add_batch(batch, table, null_keys, dedupe_by, staged)
    return keyed_rows(batch.sparkSession, table).count()


def add_batch(
    batch: DataFrame,
    table: str,
    null_keys: str = "error",
    dedupe_by: str | None = None,
    staged: bool = False,
    writer: str = "",
) -> None:
    """``upsert`` without a count of the table.

    ``writer`` names a stream that keeps the newest row of every key it has seen. As long as all of a table comes from
    it, its rows are newer than the table's, which is then not read.
    """
    spark = batch.sparkSession
    spark.catalog.refreshTable(table)
    state = _state(spark, table)
    newest = bool(writer) and (state.last == 0 or state.writer == writer)
    batch, lossy = _as_in_table(batch, table)
    own = None
    if not staged:
        batch = own = stage(batch, "upsert")
    found = batch.agg(
        F.count("*").alias("rows"),
        F.count_if(col(state.key).isNull()).alias("nulls"),
        F.count_if(lossy).alias("lossy"),
    ).first()
    if found["lossy"]:
        raise ValueError(f"{found['lossy']} rows of the batch do not fit the types of {table}")
    if found["nulls"] and null_keys == "error":
        raise ValueError(f"{found['nulls']} rows of the batch have no {state.key}")
    if found["rows"]:
        batch = batch.drop(_LOSSY)
        if dedupe_by and not newest:
            batch = _newer(latest_per_key(batch, state.key, dedupe_by), table, state.key, dedupe_by)
        _add_version(spark, table, state, batch, writer=writer)
    if own is not None:
        discard(own)


def fits_as_is(rows: DataFrame, table: str) -> bool:
    """Whether ``rows`` has the columns and types of a keyed table, so that no value is cast."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return all(kinds.get(f.name) == f.dataType for f in rows.sparkSession.table(table).schema.fields if f.name != VERSION)


def _newer(batch: DataFrame, table: str, key: str, order_by: str) -> DataFrame:
    """The rows of a batch that the table has no greater row for; only the batch's keys are looked up and grouped."""
    keys = batch.select(col(key).alias("_batch_key")).distinct()
    have = (
        keyed_rows(batch.sparkSession, table)
        .join(keys, col(key) == F.col("_batch_key"), "left_semi")
        .groupBy(col(key).alias("_have"))
        .agg(F.max(col(order_by)).alias("_order"))
    )
    older = F.col("_order") > F.coalesce(col(order_by), F.col("_order"))
    missing = F.col("_order").isNotNull() & col(order_by).isNull()
    return batch.join(have, (col(key) == F.col("_have")) & (older | missing), "left_anti")


def overwrite_partitions(df: DataFrame, table: str) -> None:
    """Replace the partitions that ``df`` has rows for, in files of a good size."""
    with _dynamic_overwrite(df.sparkSession):
        df.hint("rebalance").write.insertInto(table, overwrite=True)


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Overwrite only the partitions that receive rows, for the statements inside."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def key_of(spark: SparkSession, table: str) -> str:
    """The key column of a keyed table."""
    return _state(spark, table).key
