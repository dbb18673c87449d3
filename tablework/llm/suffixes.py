"""Removal of repeated byte strings by a sparse suffix array.

Only some suffixes are sorted. Of every ``LENGTH`` bytes the suffix is chosen whose first ``GRAM`` bytes have the smallest
hash, the last one of equals, so a string of ``LENGTH`` bytes chooses the same suffix of itself wherever it stands, and
all its places meet under that suffix. One suffix in about 14 is chosen.

Texts are kept in blocks. Splitters, drawn from a sample of suffixes, cut the order of their leading bytes into ranges.
A block sends the leading bytes of its suffixes to the ranges; a range sorts them and answers which ones stand in
several documents. For those the block sends all the bytes that the strings under the suffix reach; suffixes that agree
in all of them are one, and the range sorts the strings of the others and answers, bit by bit, which of them also start
in a document with a smaller id. The blocks then cut their own texts. A range never has more than one entry of a suffix
for each block, however many documents of the block share it, and only bit masks come back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.session import stage

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM + 1
# Suffixes a range has on average, a sample's size, and the bytes of a block that its share of the sample comes from.
RANGE_SUFFIXES = 1_000_000
SAMPLE = 20_000
SAMPLED_BYTES = 1 << 16
SAMPLED_SUFFIXES = 64
# The strings of a range are sorted in so many parts, to bound a task's memory.
PARTS = 8
ROW_GROUP = 8 << 20
# Strings of a block whose suffixes are chosen at a time.
PIECE = 1 << 17
# Answers go to every task if they take no more; beyond that they are joined with the blocks.
ANSWER_BYTES = 32 << 20

_BLOCK = "ids array<long>, sizes array<int>, body binary, leading array<long>"
_NO_ID = np.iinfo(np.int64).max


class Suffixes:
    """The chosen suffixes of a block: where each starts, and how far before it the first and last string starts."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        self.spans = C.byte_spans(body)
        strings = max(0, len(body) - LENGTH + 1)
        inside = np.zeros(strings, bool)
        for a, b in zip(offsets[:-1], offsets[1:]):
            inside[a : max(a, b - LENGTH + 1)] = True
        runs = [self._runs(begin, min(strings, begin + PIECE), inside) for begin in range(0, strings, PIECE)]
        places, first, last = (np.concatenate(x) for x in zip(*runs)) if runs else np.zeros((3, 0), np.int64)
        # A suffix that is chosen on both sides of a border is one.
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1]
        self.places = places[new]
        self.most = self.places - first[new]
        self.least = self.places - last[np.append(new[1:], True)[: len(new)]]
        self.rows = np.searchsorted(offsets, self.places, "right") - 1
        lead = np.zeros(len(self.places), np.uint64)
        for i in range(5):
            lead |= body[self.places + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.leading = lead | C.mixed(self.spans.hashes(self.places, self.places + GRAM)) >> np.uint64(40)

    def _runs(self, begin: int, end: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes chosen by the strings that start from ``begin`` to ``end``, and the first and last of these."""
        at = np.arange(begin, end + REACH - 1)
        order = self.spans.hashes(at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)
        order |= np.uint64(0xFFFFFFFF) - at.astype(np.uint64)
        # Smallest of each REACH neighbours: from the start of a stretch, and back from its end.
        padded = np.full(-(-len(order) // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(order)] = order
        table = padded.reshape(-1, REACH)
        forth = np.minimum.accumulate(table, axis=1).ravel()
        back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(back[: end - begin], forth[REACH - 1 : REACH - 1 + end - begin])
        starts = begin + np.flatnonzero(inside[begin:end])
        best = (np.uint64(0xFFFFFFFF) - (best[starts - begin] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        new = np.ones(len(best), bool)
        new[1:] = best[1:] != best[:-1]
        return best[new], starts[new], starts[np.append(new[1:], True)[: len(new)]]


class Leading:
    """The different leading bytes of a block's suffixes, and which suffixes have them."""

    def __init__(self, suffixes: Suffixes, ids: np.ndarray):
        self.values, self.of = np.unique(suffixes.leading, return_inverse=True)
        own = ids[suffixes.rows]
        low = np.full(len(self.values), _NO_ID)
        high = np.full(len(self.values), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, own)
        np.maximum.at(high, self.of, own)
        self.several = low != high


class Shared:
    """The different suffixes of a block, with all they reach, whose leading bytes stand in several documents."""

    def __init__(self, suffixes: Suffixes, leading: Leading, several: np.ndarray, ids: np.ndarray, splitters: np.ndarray):
        self.chosen = np.flatnonzero(several[leading.of])
        places, most, least = (a[self.chosen] for a in (suffixes.places, suffixes.most, suffixes.least))
        begin, end = places - most, places - least + LENGTH
        whole = C.mixed(suffixes.spans.hashes(begin, end) + (most << 8 | least).astype(np.uint64))
        values = suffixes.leading[self.chosen]
        ranges = np.searchsorted(splitters, values, "right") * PARTS + (values % np.uint64(PARTS)).astype(np.int64)
        order = np.lexsort((whole, values, ranges))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (values[order][1:] != values[order][:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        first = order[new]
        self.ranges, self.values = ranges[first], values[first]
        self.begin, self.end, self.most, self.least = begin[first], end[first], most[first], least[first]
        self.own = ids[suffixes.rows[self.chosen]]
        self.ids = np.full(len(first), _NO_ID)
        np.minimum.at(self.ids, self.of, self.own)


def _blocks(batches):
    for batch, data, offsets in C.slices(batches):
        ids = batch.column(0).fill_null(_NO_ID).to_numpy()
        part = min(len(data), SAMPLED_BYTES)
        some = Suffixes(data[:part], np.minimum(offsets, part)).leading
        some = np.unique(some)[:: max(1, len(some) // SAMPLED_SUFFIXES)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids.tolist()], pa.list_(pa.int64())),
                pa.array([np.diff(offsets).tolist()], pa.list_(pa.int32())),
                pa.array([data.tobytes()], pa.binary()),
                pa.array([some.view(np.int64).tolist()], pa.list_(pa.int64())),
            ],
            ["ids", "sizes", "body", "leading"],
        )


def _each(batches):
    """Number, ids, bytes, offsets and answers of each block."""
    for batch in batches:
        # One block at a time, so that a worker holds the body of one.
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
            ids = np.array(row["ids"], np.int64)
            offsets = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
            answers = [row[name] or [] for name in ("several", "smaller") if name in row]
            found = row["block"], ids, np.frombuffer(row["body"], np.uint8), offsets, answers
            del row, ids, offsets, answers
            yield found
            del found


def _alone(one):
    """A step over blocks by ``one`` call for each, so that nothing of a block is left when the next one is begun."""

    def run(batches):
        for block in _each(batches):
            # Arrow keeps what it frees for later; the next block is to find it free.
            yield one(*block)
            del block
            pa.default_memory_pool().release_unused()

    return run


def _cuts(ranges: np.ndarray) -> list[tuple[int, slice]]:
    """(range, slice) for each run of equal ranges."""
    borders = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
    return [(int(ranges[a]), slice(a, b)) for a, b in zip(borders[:-1], borders[1:])]


def _records(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _ask_leading(splitters):
    def one(block, ids, body, offsets, _):
        leading = Leading(Suffixes(body, offsets), ids)
        ranges = np.searchsorted(splitters.value, leading.values, "right")
        cuts = _cuts(ranges)
        return _records(
            {
                "range": pa.array([r for r, _ in cuts], pa.int32()),
                "block": pa.array([block] * len(cuts), pa.int64()),
                "values": pa.array([leading.values[s].tobytes() for _, s in cuts], pa.binary()),
                "several": pa.array([np.packbits(leading.several[s]).tobytes() for _, s in cuts], pa.binary()),
            }
        )

    return _alone(one)


def _answer_leading(key, table):
    values = [np.frombuffer(v.as_py(), np.uint64) for v in table["values"]]
    marked = [np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(v)) for m, v in zip(table["several"], values)]
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    starts = np.flatnonzero(new)
    many = (np.diff(np.append(starts, len(every))) > 1) | np.logical_or.reduceat(np.concatenate(marked)[order] > 0, starts)
    found = np.empty(len(every), bool)
    found[order] = many[np.cumsum(new) - 1]
    masks, begin = [], 0
    for v in values:
        masks.append(np.packbits(found[begin : begin + len(v)]).tobytes())
        begin += len(v)
    return pa.table({"range": table["range"], "block": table["block"], "mask": pa.array(masks, pa.binary())})


def _several(leading: Leading, answers: list[dict], splitters: np.ndarray) -> np.ndarray:
    """The answers for a block, for each of its leading bytes."""
    out = np.zeros(len(leading.values), bool)
    masks = {a["range"]: a["mask"] for a in answers}
    for r, s in _cuts(np.searchsorted(splitters, leading.values, "right")):
        out[s] = np.unpackbits(np.frombuffer(masks[r], np.uint8), count=s.stop - s.start)
    return out


def _ask_strings(splitters):
    def one(block, ids, body, offsets, answers):
        (answers,) = answers
        suffixes = Suffixes(body, offsets)
        leading = Leading(suffixes, ids)
        shared = Shared(suffixes, leading, _several(leading, answers, splitters.value), ids, splitters.value)
        cuts = _cuts(shared.ranges)
        numbers = np.stack([shared.values.view(np.int64), shared.ids, shared.most, shared.least], 1)
        texts = [body[a:b].tobytes() for a, b in zip(shared.begin, shared.end)]
        return _records(
            {
                "range": pa.array([r for r, _ in cuts], pa.int32()),
                "block": pa.array([block] * len(cuts), pa.int64()),
                "numbers": pa.array([np.ascontiguousarray(numbers[s].T).tobytes() for _, s in cuts], pa.binary()),
                "texts": pa.array([b"".join(texts[s]) for _, s in cuts], pa.binary()),
            }
        )

    return _alone(one)


def _smaller(groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a group has a smaller id than this one."""
    order = np.argsort(groups, kind="stable")
    new = np.ones(len(groups), bool)
    new[1:] = groups[order][1:] != groups[order][:-1]
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    out = np.empty(len(groups), bool)
    out[order] = least[np.cumsum(new) - 1] < ids[order]
    return out


def _pieces(lengths: np.ndarray):
    """Slices of entries that have about ``SLICE_BYTES`` together."""
    ends = np.cumsum(lengths)
    borders = np.searchsorted(ends, np.arange(0, int(ends[-1]), C.SLICE_BYTES), "left")
    borders = np.unique(np.append(borders, len(lengths)))
    return [slice(a, b) for a, b in zip(borders[:-1], borders[1:])]


def _answer_strings(key, table):
    numbers = [np.frombuffer(v.as_py(), np.int64).reshape(4, -1) for v in table["numbers"]]
    sizes = [n.shape[1] for n in numbers]
    values, ids, most, least = np.concatenate(numbers, 1)
    values = C.mixed(values.view(np.uint64))
    body = np.frombuffer(b"".join(v.as_py() for v in table["texts"]), np.uint8)
    lengths = most - least + LENGTH
    ends = np.cumsum(lengths)
    begins = ends - lengths
    reach = (most << 8 | least).astype(np.uint64)
    whole = np.empty(len(values), np.uint64)
    pieces = _pieces(lengths)
    for s in pieces:
        spans = C.byte_spans(body[begins[s][0] : ends[s][-1]])
        whole[s] = C.mixed(spans.hashes(begins[s] - begins[s][0], ends[s] - begins[s][0]) + reach[s]) ^ values[s]
    # Suffixes that agree in all they reach: only those of the smallest id need to be looked at further.
    later = _smaller(whole, ids)
    masks = np.where(later, _ALL, np.uint64(0))
    strings = [[] for _ in range(REACH)]
    for s in pieces:
        first = s.start + np.flatnonzero(~later[s])
        origin = begins[s.start]
        spans = C.byte_spans(body[origin : ends[s.stop - 1]])
        for before in range(REACH):
            some = first[(least[first] <= before) & (before <= most[first])]
            starts = begins[some] + most[some] - before - origin
            strings[before].append((some, spans.hashes(starts, starts + LENGTH) ^ values[some]))
    for before, found in enumerate(strings):
        some, hashes = (np.concatenate(x) for x in zip(*found))
        strings[before] = None
        if len(some):
            some = some[_smaller(hashes, ids[some])]
            masks[some] |= np.uint64(1 << before)
    parts = [_packed(p) for p in np.split(masks, np.cumsum(sizes)[:-1])]
    return pa.table({"range": table["range"], "block": table["block"], "mask": pa.array(parts, pa.binary())})


_ALL = np.uint64((1 << REACH) - 1)


def _packed(masks: np.ndarray) -> bytes:
    """A byte for each mask, 0 for none of the strings and 1 for all, and then the masks that are neither."""
    kinds = np.where(masks == 0, 0, np.where(masks == _ALL, 1, 2)).astype(np.uint8)
    return len(masks).to_bytes(8, "little") + kinds.tobytes() + masks[kinds == 2].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[:8], "little")
    kinds = np.frombuffer(data, np.uint8, count, 8)
    masks = np.where(kinds == 1, _ALL, np.uint64(0))
    masks[kinds == 2] = np.frombuffer(data[8 + count :], np.uint64)
    return masks


def _cut_texts(splitters, keep_text: bool):
    def one(_, ids, body, offsets, answers):
        several, smaller = answers
        suffixes = Suffixes(body, offsets)
        leading = Leading(suffixes, ids)
        shared = Shared(suffixes, leading, _several(leading, several, splitters.value), ids, splitters.value)
        found = [_unpacked(a["mask"]) for a in sorted(smaller, key=lambda a: a["range"])]
        masks = np.concatenate([np.zeros(0, np.uint64), *found])[shared.of]
        masks = np.where(shared.own > shared.ids[shared.of], _ALL, masks)
        places, most, least = (a[shared.chosen] for a in (suffixes.places, suffixes.most, suffixes.least))
        starts = np.zeros(len(body) + 1, np.int32)
        for before in range(REACH):
            hit = (masks >> np.uint64(before) & np.uint64(1)).astype(bool) & (least <= before) & (before <= most)
            starts[places[hit] - before + 1] = 1
        sums = np.cumsum(starts, dtype=np.int32)
        gone = sums[1:] > 0
        gone[LENGTH - 1 :] = sums[LENGTH:] > sums[: max(0, len(body) - LENGTH + 1)]
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        borders = offsets[1:-1]
        borders = borders[borders < len(body)]
        edge[borders] = gone[borders]
        del starts, sums
        borders = offsets[:-1]
        removed, runs = (np.zeros(len(ids), np.int64) for _ in range(2))
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            removed[filled], runs[filled] = (np.add.reduceat(x, borders[filled], dtype=np.int64) for x in (gone, edge))
        kept = []
        for a, b, n in zip(offsets[:-1], offsets[1:], removed):
            kept.append((body[a:b][~gone[a:b]] if n else body[a:b]).tobytes())
        columns = {
            "doc_id": pa.array(ids, pa.int64(), mask=ids == _NO_ID),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(runs, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        if keep_text:
            columns["kept"] = pa.array(kept, pa.binary())
        return _records(columns)

    return _alone(one)


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept``
    (the bytes that are left, which need not be whole characters).

    Every byte goes that is covered by ``LENGTH`` bytes which also start in a document of a smaller id. Ids are whole
    numbers; a null id is larger than all others and smaller than none. Rows that repeat an id are no smaller than each
    other, so they take nothing from each other. A null text is empty; a text of fewer bytes keeps them all. No rows in,
    no rows out.
    """
    spark = docs.sparkSession
    source = C.texts(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Small groups of rows in the files: a reader holds one group at a time, and a row is a whole block.
    small = {"parquet.block.size": str(ROW_GROUP)}
    blocks = C.numbered(source.mapInArrow(_blocks, _BLOCK), "block", "blocks", **small)
    total = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (n, x) -> n + x)"))).first()[0] or 0
    sample = blocks.select(F.explode("leading").alias("v")).orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    sample = np.sort(sample["v"].to_numpy().view(np.uint64))
    ranges = max(1, round(2 * total / (REACH + 1) / RANGE_SUFFIXES))
    splitters = np.unique(sample[len(sample) * np.arange(1, ranges) // ranges]) if len(sample) else sample
    held = spark.sparkContext.broadcast(splitters)
    body = blocks.select("block", "ids", "sizes", "body")

    def answered(asked: DataFrame, answer, label: str) -> DataFrame:
        found = asked.groupBy("range").applyInArrow(answer, "range int, block long, mask binary")
        masks = F.collect_list(F.struct("range", "mask")).alias(label)
        kept = stage(found.groupBy("block").agg(masks), label)
        C.let_go(spark)
        return C.sized(kept, ANSWER_BYTES)

    asked = body.mapInArrow(_ask_leading(held), "range int, block long, values binary, several binary")
    several = answered(asked, _answer_leading, "several")
    asked = body.join(several, "block", "left").mapInArrow(
        _ask_strings(held), "range int, block long, numbers binary, texts binary"
    )
    smaller = answered(asked, _answer_strings, "smaller")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    whole = body.join(several, "block", "left").join(smaller, "block", "left")
    return whole.mapInArrow(_cut_texts(held, keep_text), schema)
