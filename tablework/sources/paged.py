"""A paged JSON API as a Spark data source: page ranges are fetched by parallel tasks."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablework.schemas import PAGE_SCHEMA
from tablework.sources.pages import LIMIT_REACHED

# --- fixed values: page size and how often a page is asked for ----------------------------------
PAGE_SIZE = 100
ATTEMPTS = 3
WAIT_SECONDS = 2
TIMEOUT_SECONDS = 30
PAUSE_SECONDS = 0.1
# --- end of fixed values ------------------------------------------------------------------------

# From a page number to the status and the body of that page.
Getter = Callable[[int], tuple[int, str]]


@dataclass(frozen=True)
class HttpPages:
    """Pages of a URL, by the parameters ``page[size]`` and ``page[number]``."""

    url: str
    page_size: int = PAGE_SIZE

    def __call__(self, page_no: int) -> tuple[int, str]:
        parameters = {"page[size]": self.page_size, "page[number]": page_no}
        request = urllib.request.Request(
            f"{self.url}?{urllib.parse.urlencode(parameters)}",
            headers={"Accept": "application/json"},
        )
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as answer:
                return answer.status, answer.read().decode("utf-8")
        except urllib.error.HTTPError as failure:
            return failure.code, ""


def get_patiently(get: Getter, page_no: int, wait: float = WAIT_SECONDS) -> tuple[int, str]:
    """One page. Failures are tried again, each time after a longer wait; the limit status is an answer.

    A page that still has an error status is handed on with it: whether paging reaches the page at all is
    decided later, by ``cut_pages``.
    """
    for attempt in range(1, ATTEMPTS + 1):
        last = attempt == ATTEMPTS
        try:
            status, body = get(page_no)
        except OSError:
            if last:
                raise
        else:
            if last or status <= LIMIT_REACHED:
                return status, body
        time.sleep(wait * attempt)
    raise AssertionError("unreachable")


@dataclass
class _Pages(InputPartition):
    first: int
    last: int


def paged_source(
    name: str,
    get: Getter,
    pages: int,
    pages_per_task: int = 10,
    wait: float = WAIT_SECONDS,
    pause: float = PAUSE_SECONDS,
) -> type[DataSource]:
    """A data source of rows ``(page_no, status, body)`` of the first ``pages`` pages, for ``spark.dataSource.register``.

    How many pages there are must be said, as tasks get their pages beforehand; the API's first answer tells. 
    A lost task fetches its own pages again. Follow it with ``cut_pages``: tasks do not know of each other,
    so pages past the end are fetched too.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            starts = range(1, pages + 1, pages_per_task)
            return [_Pages(s, min(s + pages_per_task - 1, pages)) for s in starts]

        def read(self, partition: _Pages) -> Iterator[tuple]:
            for page_no in range(partition.first, partition.last + 1):
                yield (page_no, *get_patiently(get, page_no, wait))
                time.sleep(pause)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Pages
