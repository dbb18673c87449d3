"""Equi-joins that stay balanced when a few keys hold most of the rows.

``hot_keys`` finds the frequent keys of the large side by one map-side-combined sketch, of which at most two keys per
shuffle partition reach the driver: no more can hold over half an average partition. Rows with such a key, or with a null key if these are many, are dealt out over ``spread`` salts;
the rows of the other side that carry a frequent key are repeated once per salt. All other keys get salt 0 on both
sides, so the other side hardly grows. The sketch only decides what is salted, never what is joined: the result is
exact whatever it returns, because both sides are salted by the same literal list. Without frequent keys this is a
plain join. Either way Spark broadcasts the other side if it is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import col, quoted

# Fewer rows of one key are no load for a task, whatever their share.
MIN_ROWS = 10_000


@dataclass(frozen=True)
class Hot:
    """The keys of a column that are worth splitting, and whether its nulls are."""

    keys: tuple = ()
    nulls: bool = False

    def __bool__(self) -> bool:
        return bool(self.keys) or self.nulls


def spread_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(
    df: DataFrame, *columns: str, k: int | None = None, min_rows: int = MIN_ROWS
) -> dict[str, Hot]:
    """The frequent keys of each column, in one pass over these columns.

    Frequent means more than half of what a shuffle partition gets on average, and at least ``min_rows``.
    """
    k = k or 2 * spread_of(df)
    # The sketch must track several times as many keys as it reports for their counts to be close.
    tracked = min(1_000_000, max(10_000, 8 * k))
    sketches = []
    for i, name in enumerate(columns):
        sketches += [
            F.expr(f"approx_top_k({quoted(name)}, {k}, {tracked})").alias(f"top{i}"),
            F.count_if(col(name).isNull()).alias(f"nulls{i}"),
        ]
    found = df.agg(F.count("*").alias("rows"), *sketches).first()
    bar = max(min_rows, found["rows"] / (2 * spread_of(df)))
    return {
        name: Hot(
            tuple(
                e["item"]
                for e in found[f"top{i}"] or ()
                if e["count"] >= bar and e["item"] is not None
            ),
            found[f"nulls{i}"] >= bar,
        )
        for i, name in enumerate(columns)
    }


def salted_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "left",
    condition: Column | None = None,
    hot: Hot | None = None,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` on one key; ``left`` may be skewed to any degree.

    ``how`` is inner, left, left_semi or left_anti. The two sides must not share column names, and ``right_key`` is
    dropped. ``hot`` can be passed when ``left`` is expensive and its frequent keys are known from an earlier
    step. ``spread_by`` names the columns that deal out the rows of one key; all that can be hashed by default.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if hot is None:
        hot = hot_keys(left, left_key)[left_key]
    on = col(left_key) == col(right_key)
    if hot:
        spread = spread_of(left)
        split = col(left_key).isin(*hot.keys)
        if hot.nulls:
            split = col(left_key).isNull() | split
        mixed = F.pmod(F.xxhash64(*[col(c) for c in spread_by or _hashable(left)]), F.lit(spread))
        left = left.withColumn("_salt", F.when(split, mixed).otherwise(0).cast("int"))
        salts = F.when(
            col(right_key).isin(*hot.keys), F.sequence(F.lit(0), F.lit(spread - 1))
        ).otherwise(F.array(F.lit(0)))
        right = right.withColumn("_right_salt", F.explode(salts))
        on = on & (F.col("_salt") == F.col("_right_salt"))
    if condition is not None:
        on = on & condition
    return left.join(right, on, how).drop("_salt", "_right_salt", right_key)


def _hashable(df: DataFrame) -> list[str]:
    """The columns that Spark can hash: no maps and variants."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    table_key: str,
    value: str,
    name: str,
    hot: Hot | None = None,
) -> DataFrame:
    """Left join that adds ``table.value`` as ``name``; rows fan out where ``table_key`` repeats."""
    side = table.select(col(table_key).alias("_lookup_key"), col(value).alias(name))
    return salted_join(df, side, key, "_lookup_key", "left", hot=hot)
