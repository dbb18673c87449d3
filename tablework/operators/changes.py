"""Row changes of keyed tables: merge, update, delete, earlier versions, and what changed between two versions.

A change is a version of the table like an upsert: the rows of every key that it touches, and the keys that it leaves
without rows. It costs one scan of the table, for the rows that match, and writes in proportion to what changes. One
writer at a time; a change that fails on the way is never seen.

Rows without a key match nothing, so a merge neither updates nor removes them; ``update_rows`` and ``delete_rows``
refuse conditions that find such rows. Expressions are SQL text.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.functions.columns import col, quoted
from tablework.operators import tables as TB
from tablework.operators.skew import salted_join
from tablework.session import discard, stage

CHANGE = "_change"
_ACTION = "_action"


@dataclass(frozen=True)
class Merged:
    """How many rows a change updated, deleted and inserted, and the version of the table after it."""

    updated: int
    deleted: int
    inserted: int
    version: int


def version_of(spark: SparkSession, table: str) -> int:
    """The version that the table shows; 0 before the first rows."""
    return TB._state(spark, table).last


def merge_rows(
    source: DataFrame,
    table: str,
    update: Mapping[str, str] | None = None,
    update_when: str = "true",
    delete_when: str = "false",
    insert: Mapping[str, str] | None = None,
    insert_when: str = "true",
    null_keys: str = "error",
) -> Merged:
    """Merge ``source`` into a keyed table, as SQL's ``MERGE INTO table t USING source s ON t.key = s.key`` does.

    A matched row is deleted where ``delete_when`` holds, else given the values of ``update`` where ``update_when``
    holds, else kept. A source row that matches nothing is inserted where ``insert_when`` holds; ``insert`` says how, by
    default the columns by name. Expressions name the two sides ``t`` and ``s``. A condition that is null does not
    hold. Every row of a key with several rows is judged on its own.

    A key that the source has twice is an error, and so are values that do not survive the cast to the table's types.
    Source rows without a key are an error unless ``null_keys`` is ``keep``: then they are inserted.
    """
    if null_keys not in ("error", "keep"):
        raise ValueError("null_keys must be error or keep")
    spark = source.sparkSession
    spark.catalog.refreshTable(table)
    state = TB._state(spark, table)
    target = TB.keyed_rows(spark, table)
    source = stage(source, "merge")
    key, kind = state.key, target.schema[state.key].dataType
    source_key = col(key) if source.schema[key].dataType == kind else col(key).try_cast(kind)
    lossy = ~source_key.try_cast(source.schema[key].dataType).eqNullSafe(col(key))
    found = source.agg(F.count_if(col(key).isNull()).alias("nulls"), F.count_if(lossy).alias("lossy")).first()
    if found["lossy"]:
        raise ValueError(f"{found['lossy']} keys of the source do not fit the type of {table}")
    if found["nulls"] and null_keys == "error":
        raise ValueError(f"{found['nulls']} rows of the source have no {key}")
    repeated = source.filter(col(key).isNotNull()).groupBy(source_key.alias("_s")).count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"the source has several rows of one {key}")

    theirs = source.select(F.struct("*").alias("s"), source_key.alias("_s"))
    ours = target.select(F.struct("*").alias("t"), col(key).alias("_t"))
    pairs = salted_join(ours, theirs, "_t", "_s", "inner")
    action = F.when(F.expr(delete_when), "delete")
    if update:
        action = action.when(F.expr(update_when), "update")
    acted = _acted(pairs, target.columns, action.otherwise("keep"), update or {}, key, "t")
    acted = stage(acted, "merge")

    new = theirs.join(acted.select(col(key).alias("_t")).distinct(), F.col("_s") == F.col("_t"), "left_anti")
    values = insert if insert is not None else {c: f"s.{quoted(c)}" for c in target.columns}
    unknown = set(values) - set(target.columns)
    if unknown:
        raise ValueError(f"{table} has no columns {sorted(unknown)}")
    new = new.filter(F.expr(insert_when)).select(
        *[
            (F.col("_s") if c == key else F.expr(values[c]) if c in values else F.lit(None)).alias(c)
            for c in target.columns
        ]
    )
    result = _apply(spark, table, state, acted, new)
    discard(source)
    return result


def update_rows(spark: SparkSession, table: str, update: Mapping[str, str], where: str = "true") -> Merged:
    """Give the rows of a keyed table that fit ``where`` new values, from expressions over their columns."""
    return _change(spark, table, where, "update", update)


def delete_rows(spark: SparkSession, table: str, where: str = "true") -> Merged:
    """Remove the rows of a keyed table that fit ``where``."""
    return _change(spark, table, where, "delete", {})


def _change(spark: SparkSession, table: str, where: str, action: str, update: Mapping[str, str]) -> Merged:
    spark.catalog.refreshTable(table)
    state = TB._state(spark, table)
    rows, key = TB.keyed_rows(spark, table), state.key
    hit = rows.filter(F.expr(where))
    if not hit.filter(col(key).isNull()).isEmpty():
        raise ValueError(f"rows of {table} without {key} cannot be changed")
    # Other rows of a touched key are written again beside the changed ones.
    touched = stage(hit.select(col(key).alias("_touched")).distinct(), "touched")
    affected = salted_join(rows, touched, key, "_touched", "left_semi")
    chosen = F.when(F.expr(where), action).otherwise("keep")
    acted = stage(_acted(affected, rows.columns, chosen, update, key, None), "change")
    result = _apply(spark, table, state, acted, None)
    discard(touched)
    return result


def _acted(
    rows: DataFrame, columns: list[str], action: Column, update: Mapping[str, str], key: str, side: str | None
) -> DataFrame:
    """The table's columns with their new values, and what becomes of each row."""
    unknown = set(update) - set(columns)
    if unknown or key in update:
        raise ValueError(f"cannot update {sorted(unknown) or key}")
    rows = rows.withColumn(_ACTION, action)
    out = []
    for c in columns:
        old = F.col(side)[c] if side else col(c)
        out.append((F.when(F.col(_ACTION) == "update", F.expr(update[c])).otherwise(old) if c in update else old).alias(c))
    return rows.select(*out, F.col(_ACTION))


def _apply(spark: SparkSession, table: str, state: TB._State, acted: DataFrame, new: DataFrame | None) -> Merged:
    """Write the touched keys' rows, the new rows and the keys left without rows as the next version."""
    key = state.key
    counts = {r[_ACTION]: r["n"] for r in acted.groupBy(_ACTION).agg(F.count("*").alias("n")).collect()}
    touched = acted.filter(F.col(_ACTION) != "keep").select(col(key).alias("_touched")).distinct()
    left = acted.filter(F.col(_ACTION) != "delete").drop(_ACTION)
    gone = touched.join(left.select(col(key).alias("_left")), F.col("_touched") == F.col("_left"), "left_anti")
    rows, lossy = TB._as_in_table(salted_join(left, touched, key, "_touched", "left_semi"), table)
    inserted = None
    if new is not None:
        inserted, _ = TB._as_in_table(new, table)
        inserted = stage(inserted, "inserted")
        rows = rows.unionByName(inserted)
    bad = rows.filter(lossy).count()
    if bad:
        raise ValueError(f"{bad} changed rows do not fit the types of {table}")
    added = inserted.count() if inserted is not None else 0
    updated, deleted = counts.get("update", 0), counts.get("delete", 0)
    if added or updated or deleted:
        TB._add_version(spark, table, state, rows.drop(TB._LOSSY), gone.select(F.col("_touched").alias(key)))
    for staged in (acted, inserted):
        if staged is not None:
            discard(staged)
    return Merged(updated, deleted, added, version_of(spark, table))


def rows_at(spark: SparkSession, table: str, version: int) -> DataFrame:
    """The rows of a keyed table as of an earlier version; needs a table with history once it has been compacted."""
    spark.catalog.refreshTable(table)
    state = TB._state(spark, table)
    if not state.oldest <= version <= state.last:
        raise LookupError(f"{table} has versions {state.oldest} to {state.last}")
    return spark.sql(TB._rows_query(spark, table, state.key, state.base_at(version), version))


def changes_between(spark: SparkSession, table: str, after: int, upto: int | None = None) -> DataFrame:
    """What changed from version ``after`` to version ``upto``, by default the last one.

    Rows in both are left out. The others have a ``_change``: ``added`` and ``removed`` if the key has rows in one of the
    two versions only, else ``before`` and ``after``. Equal rows count: of two that became one, one is ``before``. Rows
    without a key can only be ``added``. Changes that were undone in between are none.

    Only keys that a version in between has touched are looked up, and only their rows are compared, by one aggregate.
    """
    upto = version_of(spark, table) if upto is None else upto
    if after > upto:
        raise ValueError("after must not be later than upto")
    old, new = rows_at(spark, table, after), rows_at(spark, table, upto)
    state = TB._state(spark, table)
    key = state.key
    versions = TB.versions_between(after, upto)
    if state.compacted:
        versions += f" AND {TB.VERSION} NOT IN ({', '.join(map(str, state.compacted))})"
    written = spark.table(table).filter(versions)
    keys = written.filter(col(key).isNotNull()).select(col(key).alias("_touched")).distinct()
    sides = [
        salted_join(rows, keys, key, "_touched", "left_semi").withColumn("_side", F.lit(side))
        for rows, side in ((old, -1), (new, 1))
    ]
    both = stage(sides[0].unionByName(sides[1]), "changes")
    balance = both.groupBy(*[col(c) for c in old.columns]).agg(F.sum("_side").alias("_more")).filter("_more <> 0")
    seen = both.groupBy(col(key).alias("_key")).agg(F.min("_side").alias("_from"), F.max("_side").alias("_to"))
    change = (
        F.when(F.col("_to") < 0, "removed")
        .when(F.col("_from") > 0, "added")
        .when(F.col("_more") < 0, "before")
        .otherwise("after")
    )
    changed = (
        balance.join(seen, col(key) == F.col("_key"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_more"))))
        .select(*[col(c) for c in old.columns], change.alias(CHANGE))
    )
    keyless = written.filter(col(key).isNull()).select(*[col(c) for c in old.columns], F.lit("added").alias(CHANGE))
    return changed.unionByName(keyless)
