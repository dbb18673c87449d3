import io
import json
import urllib.error
import urllib.request

import pytest

from tablework.schemas import PAGE_SCHEMA
from tablework.sources.pages import cut_pages
from tablework.sources.paged import HttpPages, get_patiently, paged_source
from tablework.sources.records import entities_of

ENTITIES = [
    (
        {
            "jurisdiction": "US",
            "legalName": {"name": "A"},
            "legalAddress": {"addressLines": ["1 St", "Fl 2"]},
        },
        ("US", "A", "1 St"),
    ),
    ({}, ("", "", "")),
    ({"jurisdiction": None, "legalName": None, "legalAddress": {"addressLines": []}}, (None, "", "")),
    ({"legalName": {"name": None}, "legalAddress": {"addressLines": None}}, ("", None, "")),
    (None, ("", "", "")),
]
RELATIONS = [
    ({}, ""),
    ({"direct-parent": None}, ""),
    ({"direct-parent": {"data": None}}, ""),
    ({"direct-parent": {}}, ""),
    ({"direct-parent": {"data": {"id": "P"}}}, "P"),
]


def page(spark, rows):
    return spark.createDataFrame(rows, PAGE_SCHEMA)


@pytest.mark.parametrize("entity, expected", ENTITIES)
def test_missing_and_null_fields(spark, entity, expected):
    body = json.dumps({"data": [{"attributes": {"lei": "X", "entity": entity}}]})
    row = entities_of(page(spark, [(1, 200, body)])).first()
    assert (row.jurisdiction, row.legal_name, row.address_line1) == expected
    assert (row.lei, row.city, row.last_update) == ("X", "", "")


@pytest.mark.parametrize("relations, expected", RELATIONS)
def test_parents(spark, relations, expected):
    body = json.dumps({"data": [{"relationships": relations}]})
    row = entities_of(page(spark, [(1, 200, body)])).first()
    assert (row.lei, row.direct_parent_lei, row.ultimate_parent_lei) == ("", expected, "")


def test_every_record_of_every_page(spark):
    def body(*keys):
        return json.dumps({"data": [{"attributes": {"lei": k}} for k in keys]})

    pages = page(spark, [(1, 200, body("a", "b")), (2, 200, body("c")), (3, 200, body())])
    assert sorted(r.lei for r in entities_of(pages).collect()) == ["a", "b", "c"]


NEXT = '{"data": [{}], "links": {"next": "x"}}'
LAST = '{"data": [{}], "links": {}}'
EMPTY = '{"data": [], "links": {"next": "x"}}'
CUTS = [
    ([(1, 200, NEXT), (2, 200, NEXT), (3, 200, NEXT), (4, 400, ""), (5, 200, NEXT)], [1, 2, 3]),
    ([(1, 200, NEXT), (2, 200, EMPTY), (3, 200, NEXT)], [1]),
    ([(1, 200, NEXT), (2, 200, LAST), (3, 200, NEXT)], [1, 2]),
    ([(i, 200, NEXT) for i in range(1, 152)], list(range(1, 152))),
    ([(1, 200, '{"data": null}'), (2, 200, NEXT)], []),
    ([(1, 400, "")], []),
    ([(1, 200, LAST), (2, 500, "")], [1]),
    ([(1, 200, NEXT), (2, 200, '{"data": [{}], "links": {"next": null}}'), (3, 503, "")], [1, 2]),
]


@pytest.mark.parametrize("pages, kept", CUTS)
def test_page_cut(spark, pages, kept):
    assert sorted(r.page_no for r in cut_pages(page(spark, pages)).collect()) == kept


def test_reached_error_fails(spark):
    with pytest.raises(Exception, match="page 2 has status 500"):
        cut_pages(page(spark, [(1, 200, NEXT), (2, 500, "")])).collect()


def test_paged_source(spark):
    def get(page_no):
        return (400, "") if page_no > 25 else (200, NEXT)

    spark.dataSource.register(paged_source("pages_of_test", get, pages=100, pages_per_task=7, pause=0))
    pages = spark.read.format("pages_of_test").load()
    assert pages.count() == 100
    assert sorted(r.page_no for r in cut_pages(pages).collect()) == list(range(1, 26))


def test_failures_are_tried_again():
    asked = []

    def flaky(page_no):
        asked.append(page_no)
        if len(asked) == 1:
            raise ConnectionError
        return (500, "") if len(asked) == 2 else (200, "{}")

    assert get_patiently(flaky, 7, wait=0) == (200, "{}")
    assert asked == [7, 7, 7]
    assert get_patiently(lambda _: (500, ""), 1, wait=0) == (500, "")

    def dead(_):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        get_patiently(dead, 1, wait=0)


def test_http_pages_without_a_network(monkeypatch):
    asked = []

    class Answer(io.BytesIO):
        status = 200

    def urlopen(request, timeout):
        asked.append((request.full_url, request.get_header("Accept"), timeout))
        if "5D=2" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 400, "limit", {}, None)
        return Answer(NEXT.encode())

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    get = HttpPages("http://example.invalid/records", page_size=50)
    assert get(1) == (200, NEXT)
    assert get(2) == (400, "")
    url = "http://example.invalid/records?page%5Bsize%5D=50&page%5Bnumber%5D=1"
    assert asked[0] == (url, "application/json", 30)
