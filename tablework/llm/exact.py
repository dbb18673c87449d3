"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries sketch (``approx_top_k``) names the digests that may hold more than one in ``HEAVY`` rows. Their winners
and sizes are counted exactly, over all rows, and broadcast, so the rows of heavy digests are settled where they are
read. All other digests have few rows each and go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.llm import common as C
from tablework.session import stage

# At most so many digests are heavy: the broadcast side has no more rows.
HEAVY = 1000


def digest(text) -> F.Column:
    """SHA-256 of the text with each run of white space as one space."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), C.SPACE + "+", " ")
    return F.sha2(plain.cast("binary"), 256)


def settled(rows: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, row`` for staged rows of ``row, doc_id, text_sha256``.

    Of equal texts the row with the smallest id stays, a null id coming last, and of rows that share the smallest id
    exactly one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    found = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(text_sha256, {HEAVY})").alias("top")).first()
    heavy = [e["item"] for e in found["top"] or () if e["count"] > 1 and e["count"] * HEAVY >= found["n"]]
    judged = []
    if heavy:
        winners = (
            rows.filter(F.col("text_sha256").isin(heavy))
            .groupBy("text_sha256")
            .agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
        )
        winners = F.broadcast(stage(winners, "winners"))
        judged = [rows.join(winners, "text_sha256")]
        rows = rows.join(winners, "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    judged.append(
        rows.withColumn("first", F.min(order).over(group)).withColumn("group_size", F.count("*").over(group))
    )
    names = ["row", "doc_id", "text_sha256", "first", "group_size"]
    out = judged[0].select(names)
    for part in judged[1:]:
        out = out.unionByName(part.select(names))
    return out.select(
        "row",
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, keep_id, group_size, kept, text_sha256``.

    A null text counts as empty, so null, empty and blank-free texts are only equal if their normalised bytes are.
    ``keep_id`` is null where no row of a group has an id. No rows in, no rows out; other columns are not read.
    """
    rows = docs.select(col(id_column).alias("doc_id"), digest(col(text_column)).alias("text_sha256"))
    return settled(C.numbered(rows, "row", "digests"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, as it is: the first by id, a null id coming last, and exactly one of rows that
    repeat it. A null text counts as empty. No rows in, no rows out."""
    name = C.free_name(docs, "row_number")
    rows = C.identified(docs, name, "documents")
    digests = rows.select(F.col(name).alias("row"), "doc_id", digest(F.col("text")).alias("text_sha256"))
    judged = settled(stage(digests, "digests"))
    return C.without(rows, judged.filter("not kept").select(F.col("row").alias(name)), name)
