import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators import tables as TB
from tablework.session import fresh_path, shared_dir, stage

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
BATCH = [("3", "new"), ("3", "new2"), ("99", "new")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def keyed(spark, name, tmp_path):
    path = str(tmp_path / "keyed")
    TB.create_keyed_table(spark, name, SCHEMA, "k", path=path)
    TB.upsert(frame(spark, [(str(i), "old") for i in range(12)]), name)
    return name, path


def content(spark, table):
    return Counter(tuple(r) for r in TB.keyed_rows(spark, table).collect())


def expected():
    rows = [(str(i), "old") for i in range(12) if i != 3]
    return Counter(rows + BATCH)


def test_upsert_keeps_duplicates_and_repeats(spark, keyed):
    table, _ = keyed
    for _ in range(2):
        assert TB.upsert(frame(spark, BATCH), table) == 14
        assert content(spark, table) == expected()


def files(path):
    return {
        os.path.join(folder, f)
        for folder, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


def test_a_small_batch_leaves_all_files_as_they_are(spark, keyed):
    table, path = keyed
    before = files(path)
    TB.upsert(frame(spark, [("3", "new")]), table)
    assert before < files(path)


def test_compaction_keeps_the_rows(spark, keyed):
    table, _ = keyed
    for i in range(8):
        TB.upsert(frame(spark, [(str(i), f"v{i}"), (str(20 + i), "added")]), table)
    want = Counter([(str(i), f"v{i}" if i < 8 else "old") for i in range(12)] + [(str(20 + i), "added") for i in range(8)])
    assert content(spark, table) == want
    TB.compact(spark, table)
    assert content(spark, table) == want
    versions = {r[0] for r in spark.table(table).select(TB.VERSION).distinct().collect()}
    assert len(versions) == 1


def test_a_batch_that_fails_before_its_commit_is_not_seen(spark, keyed, monkeypatch):
    table, _ = keyed

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(TB, "_commit", broken)
        with pytest.raises(RuntimeError):
            TB.upsert(frame(spark, BATCH), table)
    assert content(spark, table) == Counter((str(i), "old") for i in range(12))
    assert TB.upsert(frame(spark, BATCH), table) == 14
    assert content(spark, table) == expected()


def test_keys_of_another_type(spark, name):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    TB.create_keyed_table(spark, name, schema, "k")
    rows = spark.range(20).selectExpr("id AS k", "'old' AS v")
    TB.upsert(rows, name)
    assert TB.upsert(rows.selectExpr("CAST(k AS int) AS k", "'new' AS v"), name) == 20
    assert TB.upsert(rows.selectExpr("CAST(k AS string) AS k", "'newer' AS v"), name) == 20
    assert {r.v for r in TB.keyed_rows(spark, name).collect()} == {"newer"}
    for lossy in ("'x'", "1.5D", "CAST(99999999999999999999 AS decimal(20))"):
        with pytest.raises(ValueError, match="do not fit"):
            TB.upsert(spark.sql(f"SELECT {lossy} AS k, 'y' AS v"), name)


def test_older_rows_do_not_replace_newer_ones(spark, keyed):
    table, _ = keyed
    TB.upsert(frame(spark, [("1", "pp"), ("2", "nn"), ("3", None)]), table, dedupe_by="v")
    found = dict(content(spark, table).keys())
    assert (found["1"], found["2"], found["3"]) == ("pp", "old", "old")


def test_upsert_null_keys(spark, keyed):
    table, _ = keyed
    batch = frame(spark, [*BATCH, (None, "lost")])
    with pytest.raises(ValueError, match="1 rows"):
        TB.upsert(batch, table)
    assert content(spark, table) == Counter((str(i), "old") for i in range(12))
    assert TB.upsert(batch, table, null_keys="keep") == 15
    assert TB.upsert(batch, table, null_keys="keep") == 16
    with pytest.raises(ValueError):
        TB.upsert(batch, table, null_keys="other")


def test_upsert_empty_batch_and_empty_table(spark, keyed, name):
    table, _ = keyed
    assert TB.upsert(frame(spark, []), table) == 12
    other = name + "b"
    TB.create_keyed_table(spark, other, SCHEMA, "k")
    assert TB.upsert(frame(spark, []), other) == 0
    assert TB.upsert(frame(spark, BATCH), other) == 3


def test_upsert_latest(spark, keyed):
    table, _ = keyed
    batch = [("3", "p1"), ("3", "p2"), ("99", "p1")]
    assert TB.upsert(frame(spark, batch), table, dedupe_by="v") == 13
    assert content(spark, table)[("3", "p2")] == 1


def test_upsert_needs_a_keyed_table(spark, name):
    TB.create_empty_like(frame(spark, []), name)
    with pytest.raises(LookupError):
        TB.upsert(frame(spark, BATCH), name)


def test_overwrite_mode_is_restored(spark, keyed):
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_latest_per_key_keeps_rows_without_key(spark):
    rows = [("a", "1"), ("a", "2"), (None, "1"), (None, "1"), ("b", None)]
    found = TB.latest_per_key(frame(spark, rows), "k", "v").collect()
    assert Counter(tuple(r) for r in found) == Counter(
        [("a", "2"), ("b", None), (None, "1"), (None, "1")]
    )


def test_create_if_absent_keeps_first(spark, name):
    assert TB.create_if_absent(spark.range(3), name) == 3
    assert TB.create_if_absent(spark.range(9), name) == 3


def test_append_by_position_and_name(spark, name):
    TB.create_empty_like(spark.sql("SELECT 'a' AS a, 'b' AS b"), name)
    assert spark.table(name).count() == 0
    swapped = spark.sql("SELECT 'B' AS b, 'A' AS a")
    assert TB.append_table(swapped, name) == 1
    assert TB.append_table(swapped, name, by="name") == 1
    assert {tuple(r) for r in spark.table(name).collect()} == {("B", "A"), ("A", "B")}
    frame_rows = TB.append_rows(spark.table(name), swapped, by="name")
    assert frame_rows.count() == 3


def test_replace_and_drop(spark, name):
    assert TB.replace_table(spark.range(5), name) == 5
    assert TB.replace_table(spark.range(2).withColumn("x", F.lit("y")), name) == 2
    assert spark.table(name).columns == ["id", "x"]
    TB.drop_table(spark, name)
    TB.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_views(spark, name):
    TB.replace_table(spark.range(5), name)
    view = name + "_v"
    TB.create_view(spark, view, f"SELECT id FROM {name} WHERE id > 2")
    TB.create_view(spark, view, f"SELECT id FROM {name} WHERE id > 3")
    assert spark.table(view).count() == 1
    TB.register(spark.range(2), "seen")
    assert spark.table("seen").count() == 2
    assert TB.unregister(spark, "seen") and not TB.unregister(spark, "seen")


def test_entity_table(spark, name):
    TB.create_entity_table(spark, name)
    TB.create_entity_table(spark, name)
    columns = TB.keyed_rows(spark, name).dtypes
    assert len(columns) == 16 and columns[-1] == ("ingestion_timestamp", "timestamp_ntz")


def test_stage_reads_back_and_uses_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(7).withColumn("x", F.lit(None).cast("string")))
    assert staged.count() == 7 and staged.columns == ["id", "x"]
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


def test_empty_inputs(spark, name):
    none = frame(spark, [])
    assert TB.replace_table(none, name) == 0
    assert TB.append_table(none, name) == 0
    assert TB.append_table(spark.range(5).filter("id > 9").selectExpr("'a' AS k", "'b' AS v"), name) == 0
    assert TB.create_if_absent(none, name + "b") == 0
    assert TB.latest_per_key(none, "k", "v").count() == 0
    assert TB.upsert_rows(none, frame(spark, BATCH), "k").count() == 3
    assert TB.upsert_rows(frame(spark, BATCH), none, "k").count() == 3
