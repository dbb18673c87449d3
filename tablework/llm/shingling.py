"""Sets of word shingles: their hashes, and links between texts confirmed on the sets themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.session import discard, stage


# Text whose shingles are hashed at a time, or one longer row: hashing takes some hundred times its bytes.
PIECE_BYTES = 1 << 18


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes of word runs and whose they are, in order of the rows."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    begin, last = 0, len(offsets) - 1
    while begin < last:
        end = int(np.searchsorted(offsets, offsets[begin] + PIECE_BYTES, "right")) - 1
        end = min(last, max(end, begin + 1))
        part = offsets[begin : end + 1]
        found, own = _hashes(data[part[0] : part[-1]], part - part[0], width)
        hashes.append(found)
        rows.append(own + begin)
        begin = end
    return np.concatenate(hashes), np.concatenate(rows)


def _hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    low = C.LOWER[data]
    starts, ends, rows = C.word_spans(low, offsets, C.SOLID)
    if not len(rows):
        return np.zeros(0, np.uint64), rows
    words = C.Spans(C.byte_spans(low).hashes(starts, ends))
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    at = np.arange(max(0, len(rows) - width + 1))
    at = at[rows[at] == rows[at + width - 1]]
    begin = np.concatenate([at, first[short]])
    end = np.concatenate([at + width, first[short] + counts[short]])
    hashes, rows = words.hashes(begin, end), rows[begin]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each row's set, as two numbers; zeros for an empty one."""
    filled = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[filled]
    one, two = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    if len(filled):
        one[filled] = np.add.reduceat(C.mixed(hashes), starts)
        two[filled] = np.add.reduceat(C.mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    return one.view(np.int64), two.view(np.int64)


def shingles(text: str, width: int) -> set:
    """The set of a text itself, for confirming links."""
    words = text.encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def _confirmed(width: int, percent: int):
    def run(batches):
        last, own = None, set()
        for batch in batches:
            kept = []
            for i, (a, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")))):
                if a != last:
                    last, own = a, shingles(x, width)
                other = shingles(y, width)
                common = len(own & other)
                kept.append(100 * common >= percent * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept))

    return run


def confirmed(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The staged pairs ``a, b`` of ``rows`` (``row, text``) whose full sets are similar enough."""
    nodes = stage(C.few(pairs).select(F.explode(F.array("a", "b")).alias("row")).distinct(), "nodes")
    texts = stage(rows.select("row", "text").join(C.sized(nodes), "row", "left_semi"), "texts")
    small = C.fits(texts)
    one, two = (
        texts.select(F.col("row").alias(name), F.col("text").alias(f"text_{name}")) for name in ("a", "b")
    )
    one, two = (F.broadcast(side) if small else side for side in (one, two))
    held = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    links = stage(held.mapInArrow(_confirmed(width, percent), "a long, b long"), "links")
    discard(texts)
    return links
