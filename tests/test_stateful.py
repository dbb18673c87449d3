"""Upserts of a stream that keeps the newest row of every key in its state."""

import random

import pytest

from tablework.operators import tables as TB
from tablework.session import fresh_path
from tablework.streaming import incremental

SCHEMA = "k string, at string, n long"


@pytest.fixture
def landing(spark):
    folder, table = fresh_path(spark, "landed"), "t_" + fresh_path(spark, "t").rsplit("-", 1)[1]
    kinds = spark.createDataFrame([], SCHEMA).schema
    TB.create_keyed_table(spark, table, kinds, "k", fresh_path(spark, "keyed"))
    yield folder, table, kinds, fresh_path(spark, "checkpoint"), fresh_path(spark, "quarantine")
    spark.sql(f"DROP VIEW {TB.rows_view(table)}")
    spark.sql(f"DROP TABLE {table}")


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def load(spark, landing, files):
    folder, table, kinds, checkpoint, quarantine = landing
    rows = incremental.landed_files(spark, folder, kinds, "parquet", files)
    incremental.upsert_stream(rows, table, checkpoint, quarantine, "at").awaitTermination()
    return sorted((tuple(r) for r in TB.keyed_rows(spark, table).collect()), key=str)


def best(rows):
    newest = {}
    for k, at, n in rows:
        if k is not None:
            newest[k] = max(newest.get(k, ("", -1)), (at or "", n))
    return sorted(((k, at or None, n) for k, (at, n) in newest.items()), key=str)


@pytest.mark.parametrize("files", [1, 10_000])
def test_the_table_is_not_read(spark, landing, files, monkeypatch):
    def read(*_):
        raise AssertionError("the target was read")

    monkeypatch.setattr(TB, "_newer", read)
    draw, rows = random.Random(files), []
    for _ in range(2):
        for _ in range(2):
            part = [(draw.choice([*"abcdefgh", "é", "", None]), draw.choice(["1", "2", "3", None]), draw.randrange(99)) for _ in range(30)]
            part += part[:3]
            rows += part
            land(spark, landing[0], part)
        assert load(spark, landing, files) == best(rows)
    lost = spark.read.parquet(landing[4]).drop("batch").collect()
    assert sorted(map(str, (tuple(r) for r in lost))) == sorted(str(r) for r in rows if r[0] is None)


def test_rows_of_another_writer_are_looked_up(spark, landing):
    land(spark, landing[0], [("a", "2", 1), ("b", "2", 1)])
    load(spark, landing, 10)
    TB.upsert(spark.createDataFrame([("a", "5", 9), ("c", "5", 9)], SCHEMA), landing[1])
    land(spark, landing[0], [("a", "3", 2), ("b", "3", 2), ("c", "4", 2), ("d", "1", 2)])
    want = [("a", "5", 9), ("b", "3", 2), ("c", "5", 9), ("d", "1", 2)]
    assert load(spark, landing, 10) == want
    land(spark, landing[0], [("a", "6", 3), ("b", "1", 3)])
    assert load(spark, landing, 10) == [("a", "6", 3), *want[1:]]
