"""Landed pages of a paged JSON API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_REACHED = 400


def cut_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """The pages that paging would have reached, in a frame ``(page_no, status, body)``.

    Paging ends before a page with status 400, before a page without rows, after a page without a
    next link, and, if asked for, after ``max_pages`` pages. Any other error status among the pages reached fails the
    job. The end is found by one aggregate, whose single row is a scalar subquery of the filter.
    """
    page_no, status = F.col("page_no"), F.col("status")
    document = F.col("document")
    first_row = F.variant_get(document, "$.data[0]", "variant")
    next_link = F.coalesce(F.variant_get(document, "$.links.next", "string"), F.lit(""))
    last = (
        F.when(status == LIMIT_REACHED, page_no - 1)
        .when((status > LIMIT_REACHED) | document.isNull(), None)
        .when(first_row.isNull(), page_no - 1)
        .when(next_link == "", page_no)
    )
    parsed = pages.select("page_no", "status", F.try_parse_json("body").alias("document"))
    all_pages = F.lit((1 << 63) - 1 if max_pages is None else max_pages).cast("long")
    end = parsed.agg(F.least(F.min(last), all_pages).alias("last_page")).scalar()
    failed = F.raise_error(
        F.concat(F.lit("page "), page_no.cast("string"), F.lit(" has status "), status.cast("string"))
    ).cast("boolean")
    reached = page_no <= end
    return pages.filter(F.when(reached & (status > LIMIT_REACHED), failed).otherwise(reached))
