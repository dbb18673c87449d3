import json
import random
import zipfile
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tablework.operators.timejoin import asof_join
from tablework.sources import archives, bulkcsv, files, splitcsv

FIELDS = ["a", "", '"q"', '"a,b"', '"a""b"', '"line\nbreak"', '"two\n\nbreaks, and ""quotes""\n"', '5" pipe', 'x"y"', '"end"more', "é", '"\n"']


@contextmanager
def splits_of(spark, size):
    """Files in splits of about so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1}
    for name, value in names.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


def plain_records(text):
    """The records of a text, one character at a time."""
    out, held, quoted, start, i = [], "", False, True, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                held, i = held + c, i + 1
            elif c == '"':
                quoted = False
        elif c == "\n":
            out.append(held)
            held, start, i = "", True, i + 1
            continue
        elif c == '"' and start:
            quoted = True
        start = c == "," and not quoted
        held, i = held + c, i + 1
    return out + [held] if held else out


def random_text(draw, rows):
    lines = ["x,y,z"]
    for _ in range(rows):
        lines.append(",".join(draw.choice(FIELDS) for _ in range(draw.choice([1, 2, 3, 3, 3, 3, 4]))))
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_records_of_any_splits(spark, tmp_path, size):
    draw = random.Random(size)
    texts = [random_text(draw, 60) for _ in range(3)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_text(text)
    with splits_of(spark, size):
        blocks = splitcsv.file_blocks(spark, str(tmp_path))
        assert size == 100_000 or blocks.select("file", "start").distinct().count() > 20
        found = splitcsv.records(blocks).collect()
    assert sorted(r["record"] for r in found) == sorted(r for text in texts for r in plain_records(text))
    assert [r["record"] for r in found if r["first"]] == ["x,y,z"] * 3


def test_one_field_over_many_splits(spark, tmp_path):
    text = "id,t\n1," + '"' + "line, of text\n" * 400 + '"\n2,"b\nc"\n3,"open'
    (tmp_path / "a.csv").write_text(text)
    with splits_of(spark, 500):
        found = bulkcsv.read_text_csv(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 3
        rows = {r["id"]: r["t"] for r in found.collect()}
    assert rows["1"] == "line, of text\n" * 400 and rows["2"] == "b\nc" and set(rows) == {"1", "2", "3"}


def test_one_big_file_equals_a_plain_reading(spark, tmp_path):
    text = random_text(random.Random(5), 400)
    (tmp_path / "a.csv").write_text(text)
    with splits_of(spark, 700):
        split = bulkcsv.read_text_csv(spark, str(tmp_path)).collect()
    whole = bulkcsv.read_text_csv(spark, str(tmp_path)).collect()
    assert sorted(map(str, split)) == sorted(map(str, whole))
    assert len(whole) == sum(0 < len(r) and r.count(",") <= 2 for r in map(unquoted, plain_records(text)[1:]))


def unquoted(record):
    """The record with its quoted fields emptied, so that its commas are separators; its length is kept above 0."""
    out, quoted, start, i = "", False, True, 0
    while i < len(record):
        c = record[i]
        if quoted:
            if record[i : i + 2] == '""':
                i += 1
            elif c == '"':
                quoted = False
        else:
            quoted = c == '"' and start
            out += c
        start = c == "," and not quoted
        i += 1
    return out


def test_stray_quotes_in_archives(spark, tmp_path, monkeypatch):
    text = 'id,a,b\n1,x,y\n2,5" pipe,c\n3,d,e\n4,"f\n""g",h\n5,6" pipe,h\n6,i,j\n'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("a.csv", text)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.csv").write_text(text)
    expected = {"1", "2", "3", "4", "5", "6"}
    assert {r["id"] for r in bulkcsv.read_text_csv(spark, str(tmp_path / "plain")).collect()} == expected
    found = archives.read_archives(archives.list_archives(spark, f"{tmp_path}/*.zip"))
    assert {r["id"] for r in found.collect()} == expected
    assert {r["a"] for r in found.collect()} == {"x", '5" pipe', "d", 'f\n"g', '6" pipe', "i"}


def test_parts_of_an_archive(tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "PART", 50)
    text = random_text(random.Random(2), 40)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("a.csv", text)
    parts = list(archives._parts((tmp_path / "a.zip").read_bytes(), "a.zip"))
    assert len(parts) > 5 and "\n".join(parts) + "\n" == text


def test_json_folder_of_lines_and_an_array(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text("".join(json.dumps({"a": i * 100 + k, "n": {"x": k}}) + "\n" for k in range(50)))
    (tmp_path / "array.json").write_text('[{"a": 0.5, "b": "t",\n "n": {"y": [1]}}, {"a": 7}]')
    found = files.read_json(spark, str(tmp_path))
    assert found.count() == 152 and dict(found.dtypes) == {"a": "double", "b": "string", "n": "struct<x:bigint,y:array<bigint>>"}
    assert found.filter("b = 't'").select("a", "n.y").collect()[0] == (0.5, [1])


def test_asof_join_of_different_types(spark):
    left = spark.sql("SELECT 1 AS k, DATE'2024-01-02' AS t UNION ALL SELECT 2, DATE'2024-01-02'")
    right = spark.sql(
        "SELECT 1L AS k, TIMESTAMP'2024-01-01 12:00:00' AS at, 'a' AS v UNION ALL SELECT 1L, TIMESTAMP'2024-01-02 00:00:01', 'b'"
    )
    found = asof_join(left, right, ["k"], "t", "at", ["v"])
    assert dict(found.dtypes)["t"] == "date" and {(r["k"], r["v"]) for r in found.collect()} == {(1, "a"), (2, None)}
    numbers = spark.sql("SELECT 1 AS k, 5 AS t")
    times = spark.sql("SELECT 1 AS k, 4.5D AS at, 'c' AS v")
    assert asof_join(numbers, times, ["k"], "t", "at", ["v"]).first()["v"] == "c"


def test_prefix_of_states_is_settled_per_file(spark):
    rows = [("a", 0, 'h\n1,"x'), ("a", 1, "y"), ("a", 2, 'z"\n2,"w'), ("b", 0, "h"), ("b", 1, "3,q")]
    blocks = spark.createDataFrame(rows, "file string, start long, text string").repartition(5, "start")
    found = splitcsv.records(blocks)
    assert {(r["file"], r["record"], r["first"]) for r in found.collect()} == {
        ("a", "h", True),
        ("a", '1,"x\ny\nz"', False),
        ("a", '2,"w', False),
        ("b", "h", True),
        ("b", "3,q", False),
    }
    assert found.filter(F.col("first")).count() == 2
