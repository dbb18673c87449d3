import random
import zipfile
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablework.functions import columns as C
from tablework.plans.loads import array_rows
from tablework.schemas import COUNTRY_CANDIDATES
from tablework.sources import archives, bulkcsv, files

EDGES = """id,country,x
1,US,a
2,NA,b
3,DE
4,FR,c,EXTRA
5,"multi
line",d
6,,
7,a,b,
"""
EXPECTED = {
    ("1", "US", "a"),
    ("2", "", "b"),
    ("3", "DE", ""),
    ("5", "multi\nline", "d"),
    ("6", "", ""),
}


def tuples(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def edges(tmp_path):
    (tmp_path / "edges.csv").write_text(EDGES)
    return str(tmp_path)


@pytest.mark.parametrize("multiline", [None, True])
def test_bulk_edges(spark, edges, multiline):
    rows = bulkcsv.read_text_csv(spark, edges, multiline=multiline)
    assert tuples(bulkcsv.clean_text(rows)) == EXPECTED
    assert rows.count() == 5
    assert rows.select("id").distinct().count() == 5


@pytest.mark.parametrize("multiline", [None, False, True])
def test_rows_do_not_depend_on_the_columns_asked_for(spark, tmp_path, multiline):
    (tmp_path / "a.csv").write_text("id,country,x\n1,US,a\n3,DE\n4,FR,c,EXTRA\n6,,\n7,a,b,\n")
    rows = bulkcsv.read_text_csv(spark, str(tmp_path), multiline=multiline)
    assert rows.count() == 3
    for column in rows.columns:
        assert len(rows.select(column).collect()) == 3
    assert tuples(rows.select("id").filter("id > 1")) == {("3",), ("6",)}
    assert rows.groupBy("country").count().count() == 3


def test_no_tokens_keeps_namibia(spark, edges):
    rows = bulkcsv.clean_text(bulkcsv.read_text_csv(spark, edges), na_tokens=())
    assert ("2", "NA", "b") in tuples(rows)


def test_only_files_with_line_breaks_are_read_whole(spark, edges, tmp_path):
    (tmp_path / "plain file.csv").write_text('id,country,x\n11,"a ""b"", c",y\n12,NA\n\n13,a,b,c\n')
    whole = bulkcsv.files_with_line_breaks(spark, edges)
    assert [w.rsplit("/", 1)[1] for w in whole] == ["edges.csv"]
    rows = bulkcsv.clean_text(bulkcsv.read_text_csv(spark, edges))
    assert tuples(rows) == EXPECTED | {("11", 'a "b", c', "y"), ("12", "", "")}


def test_plain_files_are_split(spark, tmp_path):
    lines = "".join(f"{i},US,{'x' * 50}\n" for i in range(20_000))
    (tmp_path / "a.csv").write_text("id,country,x\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        rows = bulkcsv.read_text_csv(spark, str(tmp_path))
        parts = rows.select(F.spark_partition_id()).distinct().count()
        assert rows.count() == 20_000 and parts > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_row_whose_first_extra_field_is_empty_is_too_long(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,country,x\n8,a,b,,z\n9,"a,,,",b\n10,"a,""b,",b,,\n11,a"b,c"d\n')
    assert {r[0] for r in bulkcsv.read_text_csv(spark, str(tmp_path)).collect()} == {"9", "11"}


def test_columns_go_by_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,country\n1,US\n")
    (tmp_path / "b.csv").write_text('country,id\nDE,2\n"F\nR",3\n')
    found = bulkcsv.read_text_csv(spark, str(tmp_path))
    assert found.columns == ["id", "country"]
    assert tuples(found) == {("1", "US"), ("2", "DE"), ("3", "F\nR")}
    (tmp_path / "c.csv").write_text("id,other\n1,US\n")
    with pytest.raises(ValueError, match="columns"):
        bulkcsv.read_text_csv(spark, str(tmp_path))


def test_archives_by_the_header_of_each(spark, tmp_path):
    for name, text in (("a", "id,country\n1,US,EXTRA\n2,FR\n"), ("b", 'country,id\nDE,3\n"F\n""R",4\n5\n')):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as archive:
            archive.writestr("a.csv", text)
    found = archives.read_archives(archives.list_archives(spark, str(tmp_path)))
    assert tuples(found) == {("2", "FR"), ("3", "DE"), ("4", 'F\n"R'), (None, "5")}
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as archive:
        archive.writestr("a.csv", "id,other\n1,2\n")
    with pytest.raises(Exception, match="an archive has columns"):
        archives.read_archives(archives.list_archives(spark, str(tmp_path))).collect()


def test_dotted_header(spark, tmp_path, name):
    (tmp_path / "a.csv").write_text("LEI,Entity.LegalAddress.Country\n1,US\n2,NA\n3,\n")
    assert bulkcsv.load_bulk(spark, str(tmp_path), name) == 3
    table = spark.table(name)
    assert table.columns == ["LEI", "Entity.LegalAddress.Country"]
    assert [r[0] for r in table.orderBy("LEI").select(C.col(table.columns[1])).collect()] == [
        "US",
        "",
        "",
    ]


def test_load_bulk_replaces(spark, edges, name):
    assert bulkcsv.load_bulk(spark, edges, name) == 5
    assert bulkcsv.load_bulk(spark, edges, name) == 5


def test_csv_types_are_inferred(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('n,x,s\n1,1.5,"a\nb"\n2,2.5,c\n')
    df = files.read_file(spark, str(path))
    assert [t for _, t in df.dtypes] == ["int", "double", "string"]
    assert tuples(df) == {(1, 1.5, "a\nb"), (2, 2.5, "c")}


@pytest.mark.parametrize(
    "text",
    ['[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]', '{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n'],
)
def test_json_array_or_lines(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    assert tuples(files.read_file(spark, str(path)).select("a", "b")) == {(1, "x"), (2, "y")}


def test_format_by_extension(spark, tmp_path):
    path = str(tmp_path / "a.data")
    spark.range(3).write.parquet(path)
    for wrong in (path, "a.CSV"):
        with pytest.raises(ValueError):
            files.read_file(spark, wrong)
    assert files.read_file_or_parquet(spark, path).count() == 3


def test_array_under_key(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"meta": 1, "items": [{"a": 1}, {"a": 2}]}')
    assert tuples(array_rows(files.read_file(spark, str(path)), "items")) == {(1,), (2,)}


def test_archives(spark, tmp_path):
    for i in range(2):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as archive:
            archive.writestr("readme.txt", "no data")
            archive.writestr("first.csv", EDGES)
            archive.writestr("second.csv", "other\n1\n")
    rows = archives.read_archives(archives.list_archives(spark, str(tmp_path)))
    assert rows.columns == ["id", "country", "x"]
    assert rows.count() == 10
    assert tuples(bulkcsv.clean_text(rows)) == EXPECTED


def test_archive_without_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("readme.txt", "no data")
    with pytest.raises(Exception, match="no CSV file"):
        archives.read_archives(archives.list_archives(spark, str(tmp_path)))


def test_pick_columns():
    names = ["Other", "ParentLEI", "LEI", "Entity.LegalName", "Country", "LegalAddress.Country"]
    assert C.pick_column(names, COUNTRY_CANDIDATES) == "LegalAddress.Country"
    assert C.pick_column(["x"], COUNTRY_CANDIDATES) is None
    assert C.find_column(names, C.is_key_column) == "LEI"
    assert C.find_column(names, C.is_name_column) == "Entity.LegalName"
    assert C.find_column(["x"], C.is_key_column) is None


FIELDS = ["a", "NA", "", '"quoted"', '"a,b"', '"a""b"', '"line\nbreak"', " spaced ", "é", "-1.#IND", "nan ", "0"]


def random_csv(rng, breaks):
    """Rows of one to six fields under a header of three."""
    fields = FIELDS if breaks else [f for f in FIELDS if "\n" not in f]
    lines = ["x,y,z", "first,1,2"]
    while len(lines) < 150:
        row = [rng.choice(fields) for _ in range(rng.choice([1, 2, 3, 3, 3, 3, 4, 5, 6]))]
        lines.append(",".join(row))
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("breaks", [True, False])
def test_random_files_against_pandas(spark, tmp_path, breaks):
    rng = random.Random(11)
    expected = Counter()
    for i in range(12):
        path = tmp_path / "plain" / f"{i}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_text(random_csv(rng, breaks))
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as archive:
            archive.write(path, f"{i}.csv")
        frame = pd.read_csv(path, dtype=str, on_bad_lines="skip").fillna("")
        expected.update(frame.itertuples(index=False, name=None))
    zipped = archives.list_archives(spark, f"{tmp_path}/*.zip")
    for rows in (
        bulkcsv.read_text_csv(spark, str(tmp_path / "plain")),
        archives.read_archives(zipped),
    ):
        found = Counter(tuple(r) for r in bulkcsv.clean_text(rows).collect())
        assert found - expected == Counter() and expected - found == Counter()
