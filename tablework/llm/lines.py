"""Removal of lines that most pages of a site share.

A line's frequency is the share of its host's pages that hold it. Pages are counted per host and per host and line with
partial sums in the tasks, so neither a host with most of the pages nor a line on all of them meets in one task. The
lines of a host above a ratio are at most the average number of lines of its pages divided by the ratio: that short list
is what a page is compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.llm import common as C
from tablework.session import stage

RATIO = 0.5
# On fewer pages a ratio says nothing: the lines of a site's only page are on all of its pages.
LEAST_PAGES = 3
BLANKS = " \t\n\x0b\f\r"


def page_lines(html: Column) -> Column:
    """The text of a page as lines: what stands between tags, without scripts and styles, trimmed, without blanks."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>", "\n")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", "\n")
    return text_lines(text)


def text_lines(text: Column) -> Column:
    """The lines of a text, trimmed, without blank ones."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    # A pattern that ends in $ would begin anew at every blank of a long run of them.
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def without_boilerplate(
    pages: DataFrame,
    lines: Column,
    host: Column,
    id_column: str = "page_id",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, host_pages, n_lines, n_kept, kept (array)``.

    A line goes if it is on more than ``ratio`` of the pages of its host and the host has ``least_pages`` or more. A
    repeated line counts once per page and goes or stays as a whole. A page without a host (null or empty) belongs to no
    site and keeps its lines. Repeated rows are pages of their own. No rows in, no rows out.
    """
    rows = pages.select(
        col(id_column).alias("page_id"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("lines"),
    )
    rows = stage(rows, "page_lines")
    sites = rows.filter("host != ''").groupBy("host").agg(F.count("*").alias("host_pages"))
    sites = C.sized(stage(sites, "sites"))
    least = max(1, int(ratio * least_pages))
    common = (
        rows.filter("host != ''")
        .select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= least)
        .join(sites.filter(F.col("host_pages") >= least_pages), "host")
        .filter(F.col("n") > ratio * F.col("host_pages"))
    )
    common = common.groupBy("host").agg(F.collect_set("line").alias("common"))
    common = C.sized(stage(common, "boilerplate"))
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("common", x))
    )
    return (
        rows.join(sites, "host", "left")
        .join(common, "host", "left")
        .select("page_id", "host", "host_pages", "lines", kept.alias("kept"))
        .select(
            "page_id",
            "host",
            F.coalesce("host_pages", F.lit(0)).alias("host_pages"),
            F.size("lines").cast("long").alias("n_lines"),
            F.size("kept").cast("long").alias("n_kept"),
            "kept",
        )
    )
