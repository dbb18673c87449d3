"""Benchmark decontamination by winnowing.

Of every run of ``SPAN - GRAM + 1`` consecutive word grams the one with the smallest hash is kept as a fingerprint, on
both sides by the same rule, so any ``SPAN`` words that a document shares with an item share a fingerprint. Fingerprints
of documents and items are joined; a joined one is extended to all windows of ``SPAN`` words around it, and these are
joined with the items' windows word for word, so the hash decides nothing in the end. An item of fewer words is one
window, whose fingerprint is that of all its words.

A bit map of fixed size, made of the items' fingerprints, keeps most of the documents' other fingerprints from leaving
their task. It only ever lets too many through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.llm import common as C
from tablework.session import stage

SPAN = 10
GRAM = 5
MAP_BITS = 26
# Text whose words are hashed at a time, or one longer row: hashing takes some sixty times its bytes.
PIECE_BYTES = 1 << 18

_FOUND = pa.list_(
    pa.struct([("fp", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("window", pa.binary())])
)
_SCHEMA = "doc_id {kind}, n_words long, found array<struct<fp:long,start:int,size:int,window:binary>>"


def winnowed(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the kept grams; ``words`` are hashes of words, ``rows`` says whose they are."""
    if len(words) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(words) - GRAM + 1)
    grams = C.Spans(words).hashes(at, at + GRAM)
    windows = np.arange(len(words) - SPAN + 1)
    best, place = grams[windows], windows.copy()
    for step in range(1, SPAN - GRAM + 1):
        other = grams[step : step + len(windows)]
        lower = other <= best
        best = np.where(lower, other, best)
        place[lower] = windows[lower] + step
    kept = np.zeros(len(grams), bool)
    kept[place[rows[: len(windows)] == rows[SPAN - 1 :]]] = True
    kept = np.flatnonzero(kept)
    return kept, grams[kept]


def runs(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :])
    return at, C.mixed(C.Spans(words).hashes(at, at + size) + np.uint64(size))


def _words(data, offsets):
    low = C.LOWER[data]
    starts, ends, rows = C.word_spans(low, offsets, C.ALNUM)
    return low, starts, ends, rows, C.byte_spans(low).hashes(starts, ends)


def _phrase(low, starts, ends, first, size) -> bytes:
    return b" ".join(low[a:b].tobytes() for a, b in zip(starts[first : first + size], ends[first : first + size]))


def _item_rows(batches):
    """Of each item: its windows, the fingerprints of its text and the size of its windows."""
    for batch, data, offsets in C.slices(batches):
        low, starts, ends, rows, hashes = _words(data, offsets)
        counts = np.bincount(rows, minlength=len(batch))
        first = np.cumsum(counts) - counts
        at, grams = winnowed(hashes, rows)
        prints = [[] for _ in counts]
        for row, value in zip(rows[at], grams.view(np.int64)):
            prints[row].append(int(value))
        windows = []
        for row, (begin, count) in enumerate(zip(first.tolist(), counts.tolist())):
            size = min(count, SPAN)
            windows.append([_phrase(low, starts, ends, begin + i, size) for i in range(count - size + 1)] if count else [])
            if 0 < count < SPAN:
                prints[row] = runs(hashes[begin : begin + count], rows[begin : begin + count], count)[1].view(np.int64).tolist()
        sizes = np.minimum(counts, SPAN).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int32()),
                pa.array(prints, pa.list_(pa.int64())),
                pa.array(windows, pa.list_(pa.binary())),
            ],
            ["item_id", "size", "prints", "windows"],
        )


def _document_rows(bits, short):
    def run(batches):
        held = bits.value
        for batch, data, offsets in C.slices(batches, most=PIECE_BYTES):
            low, starts, ends, rows, hashes = _words(data, offsets)
            counts = np.bincount(rows, minlength=len(batch))
            first = np.cumsum(counts) - counts
            found = [[] for _ in counts]
            for size in (0, *short):
                at, prints = runs(hashes, rows, size) if size else winnowed(hashes, rows)
                place = prints & np.uint64((1 << MAP_BITS) - 1)
                hit = held[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)
                for p in np.flatnonzero(hit):
                    gram, row = int(at[p]), int(rows[at[p]])
                    begin, end = int(first[row]), int(first[row] + counts[row])
                    begins = [gram] if size else range(max(begin, gram - SPAN + GRAM), min(gram, end - SPAN) + 1)
                    found[row] += [
                        (int(prints[p].view(np.int64)), s - begin, size or SPAN, _phrase(low, starts, ends, s, size or SPAN))
                        for s in begins
                    ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _FOUND)],
                ["doc_id", "n_words", "found"],
            )

    return run


def _bit_map(spark, prints: DataFrame):
    """The map of the fingerprints: at most 8 MB however many there are."""
    place = F.col("fp").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    cells = (
        prints.select(
            F.shiftright(place, 6).alias("cell"),
            F.expr(f"shiftleft(1L, cast((fp & {(1 << MAP_BITS) - 1}) & 63 as int))").alias("bit"),
        )
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_hit, n_items, items (array), spans (array)``.

    ``spans`` are the merged hit runs of words, as structs of first word and end. A null or empty text has no words. A
    row without id is judged like any other. Repeated rows are judged each; repeated items are one. An item without id
    marks the words it hits, but cannot be listed. With no items nothing is hit. Other columns are not looked at.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_column]
    bench = items.select(col(item_column).alias("item_id"), F.coalesce(col(item_text).cast("string"), F.lit("")).alias("text"))
    bench = stage(
        bench.mapInArrow(_item_rows, f"item_id {kind}, size int, prints array<long>, windows array<binary>"), "items"
    )
    prints = bench.select(F.explode("prints").alias("fp")).distinct()
    windows = bench.select("item_id", F.explode("windows").alias("window")).distinct()
    short = [r[0] for r in bench.filter(f"size between 1 and {SPAN - 1}").select("size").distinct().collect()]

    source = C.texts(docs, id_column, text_column)
    schema = _SCHEMA.format(kind=dict(source.dtypes)["doc_id"])
    seen = C.numbered(source.mapInArrow(_document_rows(_bit_map(spark, prints), sorted(short)), schema), "row", "winnowed")
    hits = (
        seen.select("row", F.explode("found").alias("f")).select("row", "f.*").join(prints, "fp", "left_semi")
        .select("row", "start", "size", "window").distinct()
    )
    hits = stage(hits.join(windows.select("window").distinct(), "window", "left_semi"), "hits")
    spans = hits.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("pieces")
    )
    merged = """aggregate(pieces, cast(array() as array<struct<start:int,end:int>>), (done, x) ->
        if(size(done) > 0 and element_at(done, -1).end >= x.start,
           concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start,
                  greatest(element_at(done, -1).end, x.end) as end))),
           concat(done, array(struct(x.start as start, x.end as end)))))"""
    spans = spans.select("row", F.expr(merged).alias("spans"))
    named = (
        hits.select("row", "window").distinct().join(windows.dropna(subset=["item_id"]), "window")
        .groupBy("row").agg(F.collect_set("item_id").alias("items"))
    )
    none = F.array().cast(f"array<{kind}>")
    return (
        seen.select("row", "doc_id", "n_words").join(spans, "row", "left").join(named, "row", "left")
        .select(
            "row",
            "doc_id",
            "n_words",
            F.coalesce(F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)"), F.lit(0)).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", none).alias("items"),
            F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
        )
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with an item, as they are. Null and empty texts share none and stay;
    repeated rows are judged each; without items all rows stay."""
    name = C.free_name(docs, "row_number")
    rows = C.identified(docs, name, "documents")
    judged = contamination(rows, items, id_column=name)
    return C.without(rows, judged.filter("n_hit > 0").select(F.col("doc_id").alias(name)), name)
