"""Near-duplicates by min-max hashing.

A permutation gives a document two values, the smallest and the largest of its shingles' hashes, so a signature of
``2 * BANDS * EACH`` values takes half as many hash evaluations. A band is the two values of ``EACH`` permutations;
documents that agree in a band are candidates. Two documents of similarity 0.8 miss all bands with a probability of
about ``(1 - 0.8 ** (2 * EACH)) ** BANDS``, 5 in a million.

Documents of one set are one class. Candidates are not all pairs of a bucket: each member is compared with the bucket's
first member. Members of buckets that still hold several components are then joined by their rarest shingles, which loses
no link between them, and in which texts that only share a template do not meet. Every comparison that decides is made
on the whole sets of both texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.llm import ngramjoin
from tablework.llm.graph import components
from tablework.llm.shingling import confirmed, set_keys, shingle_hashes, shingles
from tablework.session import discard, stage

__all__ = ["grouped", "near_copies", "representatives", "shingles"]

WIDTH = 5
PERCENT = 80
BANDS = 40
EACH = 3

_draw = np.random.default_rng(20)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * EACH, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _draw.integers(0, 1 << 63, BANDS * EACH, np.int64).view(np.uint64)


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, bands): one hash of the smallest and largest values of each band's permutations."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for p in range(band * EACH, band * EACH + EACH):
            values = hashes * _FACTORS[p] + _TERMS[p]
            for best in (np.minimum, np.maximum):
                key = C.mixed(key) ^ best.reduceat(values, starts)
        out[:, band] = C.mixed(key)
    return out


def _signatures(width: int):
    def run(batches):
        for batch, data, offsets in C.slices(batches):
            hashes, rows = shingle_hashes(data, offsets, width)
            counts = np.bincount(rows, minlength=len(batch))
            one, two = set_keys(hashes, counts)
            filled = np.flatnonzero(counts)
            keys = np.zeros((0, BANDS), np.uint64)
            if len(filled):
                keys = band_keys(hashes, (np.cumsum(counts) - counts)[filled])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(one), pa.array(two), _lists(keys, filled, len(batch))],
                ["row", "doc_id", "n_shingles", "one", "two", "bands"],
            )

    return run


def _lists(table: np.ndarray, filled: np.ndarray, rows: int) -> pa.ListArray:
    """The table's rows as lists of the filled rows, and empty lists for the others."""
    sizes = np.zeros(rows + 1, np.int32)
    sizes[1:][filled] = table.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.ascontiguousarray(table).ravel().view(np.int64))
    )


def grouped(rows: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, best, kept`` for numbered rows of ``row, doc_id, text``.

    ``best`` is true for the one row that stands for its component.
    """
    signed = stage(
        rows.select("row", "doc_id", "text").mapInArrow(
            _signatures(width),
            f"row long, doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, one long, two long, bands array<long>",
        ),
        "signatures",
    )
    same = ["n_shingles", "one", "two"]
    classes = stage(
        signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("first"), F.count("*").alias("size")),
        "classes",
    )
    # Only classes of several rows need a join; every other row stands for itself.
    several = C.sized(stage(classes.filter("size > 1").drop("size"), "several"))
    member = stage(
        signed.select("row", "doc_id", *same)
        .join(several, same, "left")
        .select("row", "doc_id", "n_shingles", F.coalesce("first", "row").alias("first")),
        "members",
    )
    # The first row of each class; there can be as many of them as rows, so they are no side of a join.
    heads = signed.filter("n_shingles > 0").join(several, same, "left").filter("row = coalesce(first, row)")
    banded = stage(heads.select("row", "n_shingles", F.explode("bands").alias("band")), "bands")
    discard(signed)
    shared = banded.groupBy("band").agg(F.min("row").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = C.sized(stage(shared.select("band", "a"), "shared"))
    # A link needs sets of similar sizes, whatever they hold.
    buckets = stage(banded.join(shared, "band").select("band", "row", "n_shingles", "a"), "buckets")
    discard(banded)
    sizes = buckets.filter("row = a").select("band", F.col("n_shingles").alias("size_a"))
    near = f"100 * least(size_a, n_shingles) >= {percent} * greatest(size_a, n_shingles)"
    pairs = buckets.filter("row != a").join(sizes, "band").filter(near).select("a", F.col("row").alias("b")).distinct()
    links = confirmed(stage(pairs, "pairs"), rows, width, percent)

    label = components(links).select(F.col("node").alias("row"), "label")
    known = buckets.join(label, "row", "left").select("band", "row", "n_shingles", F.coalesce("label", "row").alias("label"))
    known = stage(known, "labelled")
    discard(buckets)
    apart = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rest = known.join(apart.select("band"), "band", "left_semi").select("row", "n_shingles").distinct()
    rest = stage(rest, "apart")
    discard(known)
    total = rest.agg(F.sum("n_shingles").alias("n")).first()["n"]
    if total:
        texts = stage(rows.select("row", "text").join(C.sized(rest.select("row")), "row", "left_semi"), "texts")
        links = ngramjoin.links_of(texts, total, width, percent, known=links)
        discard(texts)
    label = components(links)

    member = member.join(label.select(F.col("node").alias("first"), "label"), "first", "left").select(
        "row", "doc_id", "n_shingles", F.coalesce("label", "first").alias("label")
    )
    member = stage(member, "components")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    best = member.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1")
    best = C.sized(stage(best.select("label", "best"), "best"))
    named = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return member.join(best, "label", "left").select(
        "row",
        "doc_id",
        "n_shingles",
        named.alias("component_id"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("best"),
        F.coalesce(F.col("doc_id") == named, F.lit(False)).alias("kept"),
    )


def near_copies(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, n_shingles, component_id, best, kept``.

    A text of fewer words than ``width`` has them all as its one shingle; a null text or one without words has none and
    is linked with nothing. ``component_id`` is the smallest id of the component, null if none of it has one. ``kept``
    says whether a row's id is that id: of repeated ids several rows are kept, of a component without ids none is.
    ``best`` marks exactly one row of each component, the first by id, a null id coming last. No rows in, no rows out;
    other columns are not read.
    """
    rows = C.identified(C.texts(docs, id_column, text_column), "row", "documents")
    return grouped(rows, width, percent)


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, as it is: the first by id, a null id coming last, and exactly one of
    rows that repeat it. Null texts and texts without words all stay. No rows in, no rows out."""
    name = C.free_name(docs, "row_number")
    rows = C.identified(docs, name, "documents")
    plain = rows.select(F.col(name).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    judged = grouped(plain)
    return C.without(rows, judged.filter("not best").select(F.col("row").alias(name)), name)
