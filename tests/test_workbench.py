"""Catalog, SQL, models, load specs and incremental loads."""

import json
import uuid
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablework.operators import tables as TB
from tablework.plans import catalog, loads, models
from tablework.schemas import ENTITY_SCHEMA, PAGE_SCHEMA
from tablework.sources.paged import paged_source
from tablework.streaming import incremental


def test_catalog(spark, name):
    TB.replace_table(spark.range(150).withColumn("x", F.lit("y")), name)
    assert name in catalog.list_tables(spark)
    assert catalog.list_columns(spark, name) == ["id", "x"]
    info = catalog.describe(spark, name)
    assert info.columns == [{"name": "id", "type": "bigint"}, {"name": "x", "type": "string"}]
    assert info.row_count == 150
    page = catalog.preview_table(spark, name)
    assert len(page["data"]) == 100 and page["columns"] == ["id", "x"]
    assert len(catalog.preview_table(spark, name, 7)["data"]) == 7
    with pytest.raises(ValueError):
        catalog.preview(spark.range(1), -1)


def test_run_sql(spark, name):
    made = catalog.run_sql(spark, f"CREATE TABLE {name} USING parquet AS SELECT id FROM range(30);")
    assert made.message and not made.columns
    assert catalog.run_sql(spark, f"INSERT INTO {name} VALUES (99)").message
    for query, count in (
        (f"SELECT * FROM {name}", 31),
        (f"-- a comment\nSELECT * FROM {name}", 31),
        (f"WITH x AS (SELECT * FROM {name}) SELECT max(id) AS m FROM x", 1),
        ("VALUES (1), (2)", 2),
        (f"DESCRIBE {name}", 1),
    ):
        assert catalog.run_sql(spark, query).row_count == count
    result = catalog.run_sql(spark, f"SELECT id FROM {name} ORDER BY id", limit=5)
    assert (len(result.data), result.row_count, result.more, result.data[0]) == (5, 5, True, {"id": 0})
    assert not catalog.run_sql(spark, f"SELECT id FROM {name}", limit=31).more
    assert catalog.run_sql(spark, "SELECT id FROM range(25000)").row_count == 25_000
    double = catalog.run_sql(spark, f"SELECT *, struct(1 AS x) AS s FROM {name} a JOIN {name} b ON a.id = b.id WHERE a.id = 3")
    assert double.columns == ["id", "id_1", "s"] and double.data == [{"id": 3, "id_1": 3, "s": {"x": 1}}]
    with pytest.raises(ValueError, match="DIVIDE_BY_ZERO"):
        catalog.run_sql(spark, f"SELECT 1 / (id - id) AS x FROM {name}")
    for wrong in ("SELEC 1", "SELECT nothing", f"DELETE FROM {name} WHERE id = 1"):
        with pytest.raises(ValueError):
            catalog.run_sql(spark, wrong)
    assert catalog.run_sql(spark, f"DROP TABLE {name}").message


def test_sql_over_a_file(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "p"))
    assert catalog.run_sql(spark, f"SELECT * FROM parquet.`{tmp_path}/p`").row_count == 4


def entity(lei, name="N", status="ACTIVE", country="US", direct="", ultimate=""):
    address = {"country": country}
    return {
        "attributes": {
            "lei": lei,
            "entity": {"legalName": {"name": name}, "status": status, "legalAddress": address},
        },
        "relationships": {
            "direct-parent": {"data": {"id": direct}},
            "ultimate-parent": {"data": {"id": ultimate}},
        },
    }


def body(*entities, more=True):
    return json.dumps({"data": list(entities), "links": {"next": "x" if more else None}})


def test_entity_load_and_models(spark, name):
    pages = spark.createDataFrame(
        [
            (1, 200, body(entity("a", direct="b", ultimate="b"), entity("b", ultimate="b"))),
            (2, 200, body(entity("c", country="DE"), more=False)),
            (3, 200, body(entity("never"))),
        ],
        PAGE_SCHEMA,
    )
    for _ in range(2):
        assert loads.load_entities(spark, pages, name) == 3
    other = spark.newSession()
    assert {tuple(r) for r in other.table(f"{name}_country_counts").collect()} == {("US", 2, 1), ("DE", 1, 1)}
    parents = {r.lei: (r.direct_parent_name, r.ultimate_parent_name) for r in other.table(f"{name}_hierarchies").collect()}
    assert parents == {"a": ("N", "N"), "b": (None, "N")}
    target, rows = name + "_summary", TB.rows_view(name)
    assert models.run_model(spark, "entity_summary", rows, target) == 3
    assert models.run_model(spark, "entity_summary", rows, target) == 3
    summary = spark.table(target)
    assert {r.lei: r.hierarchy_level for r in summary.collect()} == {
        "a": "Subsidiary",
        "b": "Ultimate Parent",
        "c": "Standalone",
    }
    assert len(summary.columns) == 18 and "address_line1" not in summary.columns


def test_model_registry():
    assert "entity_summary" in models.list_models()
    assert "hierarchy_level" in models.model_text("entity_summary")
    with pytest.raises(LookupError):
        models.model_text("missing")


def test_archive_load(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("a.csv", "LEI,Entity.LegalAddress.Country\n1,US\n2,NA\n3,US\n4,DE\n")
    assert loads.load_archives(spark, str(tmp_path), name) == {"total": 4, "countries": 2}
    counts = spark.table(f"{name}_by_country").collect()
    assert {tuple(r) for r in counts} == {("US", 2), ("DE", 1)}
    plain = name + "_plain"
    TB.replace_table(spark.range(3), plain)
    assert loads.describe_bulk(spark, plain) == {"total": 3, "countries": 0}
    with pytest.raises(LookupError):
        models.country_counts_clean(spark.table(plain))
    for model in ("country_counts_clean", "dataset_stats"):
        assert models.run_model(spark, model, name, f"{name}_{model}") > 0
        with pytest.raises(LookupError):
            models.run_model(spark, model, plain, f"{name}_{model}")


def test_load_spec(spark, tmp_path, name):
    (tmp_path / "a.csv").write_text("n,s\n1,a\n2,b\n")
    spec = loads.LoadSpec("x", "file", name, {"file_path": str(tmp_path / "a.csv")})
    for _ in range(2):
        assert loads.run_load(spark, spec) == f"Loaded 2 rows to {name}"
    assert spark.table(name).count() == 4
    (tmp_path / "b.json").write_text('{"items": [{"a": 1}, {"a": 2}, {"a": 3}]}')
    api = loads.LoadSpec(
        "y", "api", name + "_api", {"path": str(tmp_path / "b.json"), "data_key": "items"}
    )
    assert loads.run_load(spark, api) == f"Loaded 3 rows to {name}_api"
    with pytest.raises(ValueError):
        loads.run_load(spark, loads.LoadSpec("z", "other", name))


def test_stream_of_pages_equals_batch(spark, tmp_path, name):
    landed, checkpoint = tmp_path / "landed", str(tmp_path / "checkpoint")
    landed.mkdir()
    TB.create_entity_table(spark, name)

    def run():
        incremental.upsert_entities(
            spark, str(landed), name, checkpoint, str(tmp_path / "lost")
        ).awaitTermination()
        return {r.lei: r.legal_name for r in TB.keyed_rows(spark, name).collect()}

    (landed / "1.json").write_text(body(entity("a"), entity("b")))
    assert run() == {"a": "N", "b": "N"}
    assert run() == {"a": "N", "b": "N"}
    (landed / "2.json").write_text(body(entity("b", name="new"), entity("c"), entity(None)))
    assert run() == {"a": "N", "b": "new", "c": "N"}
    assert TB.keyed_rows(spark, name).count() == 3
    lost = spark.read.schema(ENTITY_SCHEMA).parquet(str(tmp_path / "lost"))
    assert [r.lei for r in lost.collect()] == [None]


@pytest.mark.parametrize("files_per_batch", [1, 10_000])
def test_versions_of_an_entity_in_any_order(spark, tmp_path, name, files_per_batch):
    landed = tmp_path / "landed"
    landed.mkdir()
    TB.create_entity_table(spark, name)
    for file, day in enumerate([2, 3, 1]):
        one = entity("a", name=f"day {day}")
        one["attributes"]["lastUpdateDate"] = f"2024-01-0{day}"
        (landed / f"{file}.json").write_text(body(one))
    for _ in range(2):
        incremental.upsert_entities(
            spark, str(landed), name, str(tmp_path / "checkpoint"), files_per_batch=files_per_batch
        ).awaitTermination()
        assert [r.legal_name for r in TB.keyed_rows(spark, name).collect()] == ["day 3"]


def test_a_load_takes_every_page_and_fetches_it_once(spark, tmp_path, name):
    (tmp_path / "calls").mkdir()

    def get(page_no):
        with open(tmp_path / "calls" / f"{page_no}-{uuid.uuid4().hex}", "w"):
            pass
        return 200, body(entity(f"e{page_no}"), more=page_no < 150)

    spark.dataSource.register(paged_source("counted_pages", get, pages=150, wait=0, pause=0))
    assert loads.load_entities(spark, spark.read.format("counted_pages").load(), name) == 150
    assert len(list((tmp_path / "calls").iterdir())) == 150


def test_stream_without_quarantine_fails_on_missing_key(spark, tmp_path, name):
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "1.json").write_text(body(entity(None)))
    TB.create_entity_table(spark, name)
    query = incremental.upsert_entities(
        spark, str(tmp_path / "landed"), name, str(tmp_path / "checkpoint")
    )
    with pytest.raises(Exception, match="1 rows of the batch have no lei"):
        query.awaitTermination()


def test_append_stream(spark, tmp_path, name):
    landed, checkpoint = str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    rows = spark.range(10).withColumn("x", F.col("id") * 2)
    incremental.create_append_table(spark, name, rows.schema)

    def run():
        stream = incremental.landed_files(spark, landed, rows.schema, "parquet")
        incremental.append_stream(stream, name, checkpoint).awaitTermination()
        return Counter(r.id for r in spark.table(name).collect())

    rows.write.parquet(landed)
    assert run() == Counter(range(10))
    assert run() == Counter(range(10))
    rows.write.mode("append").parquet(landed)
    assert run() == Counter([*range(10), *range(10)])
