"""Joins on order rather than equality: as-of and range joins."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.operators.skew import salted_join, spread_of
from tablework.session import stage

# Bin widths of a range join double so many times.
_LEVELS = 40


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    slots: int | None = None,
) -> DataFrame:
    """Every left row with ``right_time`` and ``values`` of the latest right row of its key that is not later.

    The different moments of a key are joined, and the result is joined back to the rows, so many rows at one moment
    are one. The time line is cut into ``slots`` of about equally many moments (four per shuffle partition by default),
    and a task sorts one slot of one key at a time: a key that holds most rows is spread over all slots, and so is a
    busy hour. What a slot inherits from earlier ones comes from one aggregated row per key and slot. Left rows without
    a time or a key find nothing. Keys and times of different types are compared as what they have in common, a date as
    its midnight; the columns that come back keep their types.
    """
    time, row, hit, slot = (F.col(c) for c in ("_time", "_row", "_hit", "_slot"))
    by_key = [col(k) for k in keys]
    right_struct = F.struct(col(right_time), *[col(v) for v in values])
    names = [*keys, "_time"]
    left_side = [*by_key, col(left_time).alias("_time")]
    right_side = [*by_key, col(right_time).alias("_time")]
    common = left.select(*left_side).union(right.select(*right_side)).schema
    left_side, right_side = (
        [c.cast(f.dataType).alias(n) for c, f, n in zip(side, common, names)] for side in (left_side, right_side)
    )
    # Only moments meet moments: however many rows share one, it is one row on either side.
    usable = right.dropna(subset=[*keys, right_time])
    moments = left.select(*left_side).dropna().distinct()
    hits = usable.groupBy(*right_side).agg(F.max(right_struct).alias("_hit"))
    both = moments.withColumn("_row", F.lit(True)).unionByName(hits, allowMissingColumns=True)
    both = stage(both, "moments")
    both = _with_slots(both, slots or 4 * spread_of(left))
    within = (
        Window.partitionBy(*by_key, slot)
        .orderBy(time, row.isNotNull(), hit)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*by_key)
        .orderBy(slot)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inherited = (
        both.groupBy(*by_key, slot)
        .agg(F.max(hit).alias("_latest"))
        .withColumn("_inherited", F.last("_latest", ignorenulls=True).over(earlier))
        .drop("_latest")
    )
    found = (
        both.withColumn("_local", F.last(hit, ignorenulls=True).over(within))
        .filter(row.isNotNull())
        .join(inherited, [*keys, "_slot"], "left")
        .select(_moment(by_key, time).alias("_moment"), F.coalesce("_local", "_inherited").alias("_found"))
        .filter(F.col("_found").isNotNull())
    )
    # Back to the rows. A moment that very many of them share, or none at all, is spread over the tasks.
    rows = left.withColumn("_own", _moment(left_side[:-1], left_side[-1]))
    joined = salted_join(rows, found, "_own", "_moment", "left")
    return joined.select(
        *[col(c) for c in left.columns],
        *[F.col("_found")[c].alias(c) for c in (right_time, *values)],
    )


def _moment(keys: list[Column], time: Column) -> Column:
    """A key and a time as one text, null if one of them is."""
    parts = [p.cast("string") for p in (*keys, time)]
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def _with_slots(rows: DataFrame, slots: int) -> DataFrame:
    """Number the rows by time, from approximate quantiles. Equal times get equal numbers."""
    micros = F.unix_micros(F.col("_time").cast("timestamp")).cast("double")
    rows = rows.withColumn("_at", micros)
    shares = [i / slots for i in range(1, slots)]
    bounds = sorted(set(rows.approxQuantile("_at", shares, 0.25 / slots))) or [0.0]
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(
        splits=splits, inputCol="_at", outputCol="_slot", handleInvalid="keep"
    ).transform(rows)


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    width: float,
) -> DataFrame:
    """All pairs of a point and a range with ``low <= point < high``; the columns are numbers, and the two
    sides share no column name.

    Both sides are put into bins of ``width`` and joined on the bin, so no pair outside a common bin is looked
    at. Bins double in width from level to level; a range takes the level at which it touches two bins at most,
    however long it is, and a point stands in one bin of each level that some range uses. ``width`` is the narrowest:
    choose it near the usual length of a short range.
    """
    usable = ranges.filter(col(low) < col(high))
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_range_level"))
    level = F.greatest(F.lit(0), F.least(F.lit(_LEVELS), F.ceil(F.log2((col(high) - col(low)) / F.lit(float(width))))))
    levelled = usable.withColumn("_range_level", level.cast("int"))
    # One row for each of at most ``_LEVELS`` + 1 levels.
    levels = sorted(r[0] for r in levelled.select("_range_level").distinct().collect())
    first, last = (F.floor(col(c) / size) for c in (low, high))
    # A range longer than all levels has the whole line for its bin.
    first, last = (F.when(F.col("_range_level") == _LEVELS, 0).otherwise(x) for x in (first, last))
    binned = levelled.withColumn("_place", F.explode(F.array_distinct(F.array(first, last))))
    binned = binned.withColumn("_range_bin", _bin_name(F.col("_range_level"), F.col("_place")))
    places = [
        _bin_name(F.lit(n), F.lit(0) if n == _LEVELS else F.floor(col(point) / F.lit(width * 2.0**n)))
        for n in levels
    ]
    placed = points.filter(col(point).isNotNull())
    placed = placed.withColumn("_bin", F.explode(F.array(*places)) if places else F.lit(None).cast("string"))
    inside = (col(low) <= col(point)) & (col(point) < col(high))
    return salted_join(placed, binned, "_bin", "_range_bin", "inner", condition=inside).drop(
        "_bin", "_range_bin", "_range_level", "_place"
    )


def _bin_name(level: Column, place: Column) -> Column:
    return F.concat(level.cast("string"), F.lit(":"), place.cast("long").cast("string"))
