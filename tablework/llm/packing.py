"""Best-fit-decreasing packing of tokenised documents into sequences.

Best-fit decreasing only looks at lengths, and there are no more different lengths than a sequence has tokens. The
driver therefore sees one count per length, never a piece, and packs whole runs of equal lengths at a time: a segment
tree over the remaining capacities finds the tightest open bins in logarithmic time, and a rule says which ranks of a
length go into which bins. Tasks then place every piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.session import stage

CAPACITY = 2048
# Parts of words a worker remembers the ids of; beyond that it starts anew.
KNOWN_PARTS = 300_000


class Tightest:
    """A segment tree over capacities: the smallest open one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def change(self, capacity: int, bins: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += bins
            node >>= 1

    def fit(self, length: int) -> int | None:
        node = length + self.leaves
        while not self.open[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def packing_rules(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows of (length, first rank, first bin, pieces per bin, offset), by length and rank.

    The pieces of a length from a rule's first rank up to the next rule's go, so many to a bin, into consecutive bins,
    each bin's pieces one after the other from the offset on. This is best-fit decreasing, run by run: the bin that
    has just taken a piece stays the tightest as long as it can take another of the same length.
    """
    tree, free, rules, bins = Tightest(capacity), {}, [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            free.setdefault(room, []).append((first, many))
            tree.change(room, many)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.fit(length)
            if room is None:
                room = capacity
                first, many = bins, -(-left // (capacity // length))
                bins += many
            else:
                first, many = free[room].pop()
                tree.change(room, -many)
            each = room // length
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            rules.append((length, rank, first, each, capacity - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + (rest > 0), many - full - (rest > 0))
            rank += full * each + rest
            left -= full * each + rest
    return np.array(sorted(rules), np.int64).reshape(-1, 5)


# The bytes of printable ASCII, white space and accented Latin letters in UTF-8.
_PLAIN = bytes([*range(9, 14), *range(32, 127), 0xC3, *range(0x80, 0xC0)])
# How the tokenizer's own rule splits lower-case text of these characters.
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9 \t-\r]+")


class Encoder:
    """From texts in bytes to little-endian ids in bytes.

    A text of printable ASCII and accented Latin letters needs no normalisation but lower case. It is split here by the
    tokenizer's rule and each part merged by the tokenizer's model, once, as a worker remembers parts from task to task.
    Of any other text the words that are not of this kind go through the tokenizer as they are: no token reaches across
    white space.
    """

    def __init__(self, tokenizer: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer)
        self.model = self.whole.model
        self.special = sorted(t.content.encode() for t in self.whole.get_added_tokens_decoder().values())
        self.parts: dict[str, bytes] = {}
        # The printable sign of each byte in the model's vocabulary.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _part(self, part: str) -> bytes:
        signs = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _plain(self, text: bytes) -> bytes:
        parts = _PARTS.findall(text.decode().lower())
        ids = list(map(self.parts.get, parts))
        if None in ids:
            if len(self.parts) > KNOWN_PARTS:
                self.parts.clear()
            for i, found in enumerate(ids):
                if found is None:
                    part = parts[i]
                    found = self.parts.get(part)
                    if found is None:
                        found = self.parts[part] = self._part(part)
                    ids[i] = found
        return b"".join(ids)

    def _word(self, word: bytes) -> bytes:
        if self._is_plain(word):
            return self._plain(word)
        ids = self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _is_plain(self, text: bytes) -> bool:
        return not text.translate(None, _PLAIN) and not (b"<" in text and any(s in text for s in self.special))

    def __call__(self, text: bytes) -> bytes:
        if self._is_plain(text):
            return self._plain(text)
        return b"".join(map(self._word, text.split()))


def _encoder(tokenizer: str) -> Encoder:
    """The worker's encoder for a tokenizer, which keeps what it knows from task to task."""
    return C.remembered(("packing", tokenizer), lambda: Encoder(tokenizer))


def _pieces(tokenizer, capacity: int, end: bytes, keep_ids: bool):
    def run(batches):
        encode = _encoder(tokenizer.value)
        for batch, data, offsets in C.slices(batches, keep=True):
            out = ([], [], [], [], [], [])
            for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
                ids = encode(data[a:b].tobytes()) + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    values = (row, piece, start, len(part) // 4, zlib.crc32(part), part if keep_ids else None)
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(values, kind) for values, kind in zip(out, kinds)]
            columns[0] = batch.column(0).take(columns[0])
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _places(rules):
    def run(batches):
        table = rules.value
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            rule = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            at = rank - rule[:, 1]
            bins = rule[:, 2] + at // rule[:, 3]
            offsets = rule[:, 4] + at % rule[:, 3] * length
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"]
            )

    return run


def packed(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``.

    ``tokenizer`` is the path of a tokenizer file on the driver, of a kind that drops white space. Every document is
    its ids and ``end_id``; a null or empty text is that one id. Only longer ones than ``capacity`` are cut. Repeated
    rows are packed each, a null id stays null, equal lengths are dealt out in the order of the rows. No rows in, no
    rows out.
    """
    spark = docs.sparkSession
    source = C.texts(docs, id_column, text_column)
    with open(tokenizer, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast(file.read())
    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    end = np.array([end_id], "<u4").tobytes()
    cut = source.mapInArrow(_pieces(held, capacity, end, keep_ids), schema)
    pieces = C.numbered(cut if keep_ids else cut.drop("ids"), "row", "pieces")

    # Ranks among equal lengths: a length may hold most of the rows, so they are counted in many parts.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    sizes = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("row")
    ranked = (
        pieces.withColumn("own", F.row_number().over(own))
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("own") - 1)
    )
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rules = spark.sparkContext.broadcast(packing_rules(counts, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_places(rules), schema)
