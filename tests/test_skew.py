"""Joins with a key that holds most of the rows: same result, balanced work."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablework.operators.skew import Hot, hot_keys, salted_join
from tablework.operators.timejoin import asof_join, range_join
from tablework.plans.models import entity_hierarchies, entity_summary


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have key ``hot``, a third have none, the rest have few each."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, None)
        .otherwise((F.col("id") % 500).cast("string"))
    )
    return spark.range(30_000).select("id", key.alias("key"))


@pytest.fixture(scope="module")
def side(spark):
    rows = [("hot", "H"), ("hot", "H2"), ("2", "two"), ("5", "five"), ("none", "N"), (None, "null")]
    return spark.createDataFrame(rows, "k string, value string")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_same_as_plain_join(spark, skewed, side, how, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plain = skewed.join(side, F.col("key") == F.col("k"), how)
        if how in ("inner", "left"):
            plain = plain.select("id", "key", "value")
        for hot in (Hot(), Hot(("hot",), True), Hot(("hot", "2", "absent")), Hot(nulls=True), None):
            salted = salted_join(skewed, side, "key", "k", how, hot=hot)
            assert salted.columns == plain.columns
            assert bag(plain) == bag(salted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_columns_that_cannot_be_hashed(spark, skewed, side):
    odd = skewed.select("id", "key", F.create_map(F.lit("a"), F.col("id")).alias("m"))
    found = salted_join(odd, side, "key", "k", "left", hot=Hot(("hot",), True))
    assert found.count() == salted_join(skewed, side, "key", "k", "left", hot=Hot()).count()


def test_unsupported_type(skewed, side):
    with pytest.raises(ValueError):
        salted_join(skewed, side, "key", "k", "full")


def test_hot_keys(spark, skewed):
    found = hot_keys(skewed, "key", "id")
    assert found == {"key": Hot(("hot",), True), "id": Hot()}
    assert not found["id"]
    # Every key counts as frequent if one row is enough and the share is small, up to the number asked for.
    small = hot_keys(skewed.limit(9), "key", k=3, min_rows=1)["key"]
    assert "hot" in small.keys and None not in small.keys and small.nulls
    assert hot_keys(skewed.limit(0), "key", min_rows=0)["key"].keys == ()


def test_work_is_spread(spark, skewed, side):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = salted_join(skewed, side, "key", "k", "left")
        sizes = [
            r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        ]
        assert max(sizes) < sum(sizes) / 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


ENTITIES = "lei string, legal_name string, status string, country string, direct_parent_lei string, ultimate_parent_lei string"


def test_duplicate_and_empty_keys_fan_out(spark):
    rows = [
        ("a", "A", "ACTIVE", "US", "p", "p"),
        ("p", "P1", "ACTIVE", "DE", "", "p"),
        ("p", "P2", "LAPSED", "JP", "", ""),
        ("", "E", "ACTIVE", None, None, ""),
    ]
    entities = spark.createDataFrame(rows, ENTITIES)
    found = bag(entity_hierarchies(entities))
    # a has two direct and two ultimate parents; P1 has no direct parent, so the entity without key matches.
    assert found == Counter(
        [("a", "A", d, u) for d in ("P1", "P2") for u in ("P1", "P2")]
        + [("p", "P1", "E", "P1"), ("p", "P1", "E", "P2")]
    )
    levels = Counter(
        (r.legal_name, r.direct_parent_name, r.ultimate_parent_name, r.hierarchy_level, r.region_group)
        for r in entity_summary(entities).collect()
    )
    assert levels == Counter(
        [("A", d, u, "Subsidiary", "North America") for d in ("P1", "P2") for u in ("P1", "P2")]
        + [("P1", "E", u, "Ultimate Parent", "Europe") for u in ("P1", "P2")]
        # A null direct parent satisfies neither test, and the ultimate parent is the entity without key itself.
        + [("E", None, "E", "Ultimate Parent", "Other")]
    )


@pytest.mark.parametrize("slots", [None, 2, 7])
def test_asof_against_brute_force(spark, slots):
    left = [(i, i % 3, i * 7 % 400) for i in range(120)]
    left += [(500, None, 10), (501, 1, 0), (502, 1, None)]
    right = [(i % 3, i * 11 % 390 + 1, i) for i in range(60)] + [(None, 1, 99)]

    def frame(rows, columns, time):
        df = spark.createDataFrame(rows, columns)
        return df.withColumn(time, F.timestamp_seconds(F.col(time) * 1000))

    found = asof_join(
        frame(left, "id int, key int, t int", "t"),
        frame(right, "key int, rt int, value int", "rt"),
        ["key"],
        "t",
        "rt",
        ["value"],
        slots=slots,
    )

    def best(key, t):
        if key is None or t is None:
            return None
        hits = [(rt, v) for k, rt, v in right if k == key and rt <= t]
        return max(hits)[1] if hits else None

    assert {r.id: r.value for r in found.collect()} == {i: best(k, t) for i, k, t in left}
    assert found.count() == len(left)


def test_range_join_against_brute_force(spark):
    points = [(i, i * 13 % 200) for i in range(300)]
    ranges = [(j, j * 5, j * 5 + j) for j in range(40)]
    found = range_join(
        spark.createDataFrame(points, "id int, x int"),
        spark.createDataFrame(ranges, "r int, lo int, hi int"),
        "x",
        "lo",
        "hi",
        width=16,
    )
    wanted = Counter((i, j) for i, x in points for j, lo, hi in ranges if lo <= x < hi)
    assert Counter((r.id, r.r) for r in found.collect()) == wanted
