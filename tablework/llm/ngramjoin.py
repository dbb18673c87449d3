"""Join of texts with themselves by the Jaccard similarity of their word n-grams.

A document's n-grams are put in order from rare to common. Two sets that are similar enough then share an n-gram among the
first few of both (prefix filter), are of similar sizes (length filter), share it so early that enough can follow
(positional filter), and differ after it in so few n-grams that enough can still be equal (suffix filter). Documents that
meet in an n-gram of their prefixes and pass are candidates, each pair is confirmed on the full sets once, and no link is
lost.

Frequencies are counted over all documents. A block of documents sends each part of the hash range its n-grams as packed
arrays, and gets back which of them some other document has, and how many: the order goes by the power of two of the
number and then by hash. N-grams that only one document has cannot join; they stand first in the order and are known by
their number alone. N-grams of many documents of a block are sent as counts, so a part holds a bounded number of entries
per block and n-gram.

Only components are asked for, so a common n-gram does not make all its pairs candidates: a document is compared with the
leading documents of a few of its n-grams, then with others as long as it is not of an n-gram's largest component, and at
last with all that are still in other components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.llm.graph import components
from tablework.llm.shingling import confirmed, set_keys, shingle_hashes
from tablework.session import discard, stage

WIDTH = 4
PERCENT = 85
# N-grams that one task counts at a time, on average.
PART_GRAMS = 4 << 20
# An n-gram of more documents of a block is sent as a count; which documents have it stays with the block.
COMMON = 8
# In so many turns a document is compared with leading ones of its n-grams, in the first with a few of them, before it is
# with all that are still in other components than it is.
STARS = 4
FEW = 4
_REQUEST = "part int, block long, kind int, grams binary, counts binary, rows binary, sizes binary"
_REPLY = "block long, kind int, grams binary, docs binary, levels binary, rows binary, sizes binary"
_ENTRY = "row long, n int, gram long, pos int, low long, high long"
_RARE, _COMMON, _OWN = 0, 1, 2


def _requests(width: int, parts: int):
    """What a block of documents tells each part: its n-grams with their documents' numbers in the block, or counts."""

    def run(batches):
        for batch, data, offsets in C.slices(batches):
            hashes, docs = shingle_hashes(data, offsets, width)
            if not len(hashes):
                continue
            rows = batch.column("row").to_numpy()
            sizes = np.bincount(docs, minlength=len(batch))
            part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            grams = part << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
            order = np.argsort(grams, kind="stable")
            grams, docs = grams[order], docs[order].astype(np.uint16)
            begins = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            counts = np.diff(np.r_[begins, len(grams)])
            often = np.repeat(counts > COMMON, counts)
            frequent = counts > COMMON
            out = []
            block = int(rows[0])
            for kind, which, second in (
                (_RARE, grams[~often], docs[~often]),
                (_COMMON, grams[begins[frequent]], counts[frequent].astype(np.uint16)),
            ):
                where = (which >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else []
                low = which.astype(np.uint32)
                for begin, end in zip(cuts, [*cuts[1:], len(where)]):
                    out.append((int(where[begin]), block, kind, low[begin:end].tobytes(), second[begin:end].tobytes(), None, None))
            home = parts + int(C.mixed(np.array([block], np.int64).view(np.uint64))[0] % np.uint64(parts))
            out.append(
                (home, block, _OWN, grams[often].tobytes(), docs[often].tobytes(), rows.tobytes(), sizes.astype(np.int32).tobytes())
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), _types(_REQUEST))], _names(_REQUEST)
            )

    return run


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [kinds[field.split()[1]] for field in schema.split(", ")]


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _levels(key, table):
    """The power of two of the frequency of every n-gram of a part that several documents have, for each block."""
    rows, out = table.to_pylist(), []
    grams = [np.frombuffer(r["grams"], np.uint32) if r["kind"] != _OWN else None for r in rows]
    asked = [i for i, r in enumerate(rows) if r["kind"] != _OWN]
    for r in rows:
        if r["kind"] == _OWN:
            out.append((r["block"], _OWN, r["grams"], r["counts"], None, r["rows"], r["sizes"]))
    if asked:
        weights = [
            np.frombuffer(rows[i]["counts"], np.uint16) if rows[i]["kind"] == _COMMON else np.ones(len(grams[i]), np.uint16)
            for i in asked
        ]
        _, places = np.unique(np.concatenate([grams[i] for i in asked]), return_inverse=True)
        found = np.bincount(places, np.concatenate(weights))
        levels = np.ceil(np.log2(found)).astype(np.uint8)[places]
        begin = 0
        for i in asked:
            r, own = rows[i], levels[begin : begin + len(grams[i])]
            begin += len(own)
            shared = own > 0
            if shared.any():
                full = grams[i][shared].astype(np.uint64) | np.uint64(r["part"]) << np.uint64(32)
                docs = np.frombuffer(r["counts"], np.uint16)[shared].tobytes() if r["kind"] == _RARE else None
                out.append((r["block"], r["kind"], full.tobytes(), docs, own[shared].tobytes(), None, None))
    columns = zip(*out) if out else [()] * len(_names(_REPLY))
    return pa.table([pa.array(c, t) for c, t in zip(columns, _types(_REPLY))], _names(_REPLY))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first n-grams another similar set must share one of."""
    return n - -(-n * percent // 100) + 1


def _after(bits: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each n-gram the exclusive or of the bits of those that come after it in its document."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)])
    return sums[np.cumsum(counts)][docs] ^ sums[1:]


def _entries(percent: int, parts: int):
    """The n-grams of a block's prefixes that other documents have, with what the filters need."""

    def run(key, table):
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == _OWN)
        ids, sizes = np.frombuffer(own["rows"], np.int64), np.frombuffer(own["sizes"], np.int32).astype(np.int64)
        grams, docs, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
        for r in rows:
            if r["kind"] == _RARE:
                grams.append(np.frombuffer(r["grams"], np.uint64))
                docs.append(np.frombuffer(r["docs"], np.uint16))
                levels.append(np.frombuffer(r["levels"], np.uint8))
        common = [r for r in rows if r["kind"] == _COMMON]
        if common:
            names = np.concatenate([np.frombuffer(r["grams"], np.uint64) for r in common])
            known = np.concatenate([np.frombuffer(r["levels"], np.uint8) for r in common])
            order = np.argsort(names)
            held = np.frombuffer(own["grams"], np.uint64)
            grams.append(held)
            docs.append(np.frombuffer(own["docs"], np.uint16))
            levels.append(known[order][np.searchsorted(names[order], held)])
        grams, docs, levels = np.concatenate(grams), np.concatenate(docs).astype(np.int64), np.concatenate(levels)
        order = np.lexsort((grams, levels, docs))
        grams, docs, levels = grams[order], docs[order], levels[order].astype(np.int64)
        shared = np.bincount(docs, minlength=len(ids))
        place = np.arange(len(docs)) - np.repeat(np.cumsum(shared) - shared, shared) + (sizes - shared)[docs]
        # Each n-gram flips one of 128 bits.
        spread = C.mixed(grams)
        bit = np.uint64(1) << (spread & np.uint64(63))
        upper = (spread & np.uint64(64)) > 0
        low, high = (_after(np.where(inside, bit, np.uint64(0)), docs, shared) for inside in (~upper, upper))
        kept = place < prefix(sizes, percent)[docs]
        of = docs[kept]
        grams, low, high = (x[kept].view(np.int64) for x in (grams, low, high))
        columns = [ids[of], sizes[of], grams, place[kept], low, high]
        return pa.table([pa.array(c).cast(t) for c, t in zip(columns, _types(_ENTRY))], _names(_ENTRY))

    return run


def entries(rows: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """``row, n, gram, pos, cell, low, high`` for each n-gram in the prefix of a row that other rows have too.

    ``rows`` are ``row, text`` with ``total`` n-grams; their numbers are different.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, total // PART_GRAMS + 1)
    asked = rows.select("row", "text").mapInArrow(_requests(width, parts), _REQUEST)
    found = asked.groupBy("part").applyInArrow(_levels, _REPLY)
    return found.groupBy("block").applyInArrow(_entries(percent, parts), _ENTRY)


def _met(percent: int) -> Column:
    """Whether two entries of an n-gram pass all filters; those of the second have ``_x`` behind their names."""
    need = F.expr(f"({percent} * (n + n_x) + {99 + percent}) div {100 + percent}")
    length = F.expr(f"100 * least(n, n_x) >= {percent} * greatest(n, n_x)")
    position = F.expr("least(n - pos, n_x - pos_x)") >= need
    # All before the first common n-gram differ, and so do as many after it at least as there are different bits.
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("low_x"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high_x")))
    suffix = F.expr("pos + pos_x") + apart <= F.expr("n + n_x") - 2 * need
    return length & position & suffix


def _as_other(held: DataFrame) -> DataFrame:
    return held.select("gram", *[F.col(c).alias(f"{c}_x") for c in held.columns if c != "gram"])


def _pairs(held: DataFrame, others: DataFrame, tried: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs across components that have not been tried and pass the filters, in the first turn a few of each row."""
    across = (F.col("label") != F.col("label_x")) & (F.col("row") != F.col("row_x"))
    met = held.join(others, "gram").filter(across & _met(percent)).select("row", "row_x")
    pairs = met.withColumn("a", F.least("row", "row_x")).withColumn("b", F.greatest("row", "row_x"))
    pairs = pairs.dropDuplicates(["a", "b"]).join(C.few(tried), ["a", "b"], "left_anti")
    if turn == 0:
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.xxhash64("row_x", F.lit(turn)), "row_x"))
        pairs = pairs.withColumn("place", place).filter(F.col("place") <= FEW)
    return stage(pairs.select("a", "b"), f"pairs{turn}")


def _mixed(found: DataFrame, links: DataFrame | None, turn: int) -> DataFrame:
    """The entries of n-grams that several components have, with their components."""
    if links is None:
        held = found.withColumn("label", F.col("row"))
    else:
        label = C.few(components(links)).select(F.col("node").alias("row"), "label")
        held = found.join(label, "row", "left").withColumn("label", F.coalesce("label", "row"))
    held = C.few(stage(held, f"labelled{turn}"))
    several = held.groupBy("gram").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most")
    mixed = stage(held.join(several.select("gram"), "gram", "left_semi"), f"mixed{turn}")
    discard(held)
    return C.few(mixed)


def links_of(
    rows: DataFrame,
    total: int,
    width: int,
    percent: int,
    copies: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Confirmed links ``a, b`` that, with the staged ``known`` ones, connect what all links between ``rows`` connect.

    ``rows`` are ``row, text`` with ``total`` n-grams; those whose row is in ``copies`` are left out of all pairs.
    """
    found = entries(rows, width, percent, total)
    if copies is not None:
        found = found.join(copies, "row", "left_anti")
    found = C.few(stage(found, "entries"))
    links = known
    if links is None:
        links = stage(found.select(F.col("row").alias("a"), F.col("row").alias("b")).limit(0), "links")
    tried = stage(links.limit(0), "tried")
    for turn in range(STARS + 1):
        held = _mixed(found, links if turn else known, turn)
        if held.isEmpty():
            break
        # Whoever is not of an n-gram's largest component is compared with one of that, at last with all others.
        size = held.groupBy("gram", "label").agg(F.count("*").alias("size"))
        largest = size.groupBy("gram").agg(F.max_by("label", F.struct("size", "label")).alias("label"))
        outside = held.join(largest, ["gram", "label"], "left_anti")
        others = held
        if turn < STARS:
            own = held.join(largest, ["gram", "label"], "left_semi")
            lead = own.groupBy("gram").agg(F.min_by("row", F.xxhash64("row", F.lit(turn))).alias("row"))
            others = held.join(lead, ["gram", "row"], "left_semi")
        pairs = _pairs(outside, _as_other(others), tried, percent, turn)
        if not pairs.isEmpty():
            links = stage(links.unionByName(confirmed(pairs, rows, width, percent)), "links")
            tried = stage(tried.unionByName(pairs), "tried")
        discard(held)
    discard(found)
    return links


def _sets(width: int):
    def run(batches):
        for batch, data, offsets in C.slices(batches):
            hashes, docs = shingle_hashes(data, offsets, width)
            counts = np.bincount(docs, minlength=len(batch))
            one, two = set_keys(hashes, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(one), pa.array(two)],
                ["row", "doc_id", "n_shingles", "one", "two"],
            )

    return run


def linked(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, n_shingles, class_row, component_id``.

    Two rows are linked if ``100 * intersection >= percent * union`` of their n-grams. A text of fewer words than
    ``width`` has them all as its one n-gram; a null text or one without words has none and is linked with nothing, not
    even its like. Rows of one set are one class, named by one of its rows. ``component_id`` is the smallest id that
    links lead to, null if no row of the component has one. Repeated ids are rows like any other. No rows in, no rows
    out; other columns are not read.
    """
    rows = C.identified(C.texts(docs, id_column, text_column), "row", "documents")
    schema = f"row long, doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, one long, two long"
    signed = stage(rows.select("row", "doc_id", "text").mapInArrow(_sets(width), schema), "sets")
    same = ["n_shingles", "one", "two"]
    classes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("class_row"), F.count("*").alias("size"))
    several = C.sized(stage(classes.filter("size > 1").drop("size"), "several"))
    member = stage(
        signed.join(several, same, "left").select(
            "row", "doc_id", "n_shingles", F.coalesce("class_row", "row").alias("class_row")
        ),
        "members",
    )
    copies = stage(member.filter("row != class_row").select("row"), "copies")
    total = member.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    label = components(links_of(rows.select("row", "text"), total, width, percent, C.sized(copies)))
    member = stage(
        member.join(label.select(F.col("node").alias("class_row"), "label"), "class_row", "left").withColumn(
            "label", F.coalesce("label", "class_row")
        ),
        "components",
    )
    least = member.groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    least = C.sized(stage(least.select("label", "least"), "least"))
    return member.join(least, "label", "left").select(
        "row",
        "doc_id",
        "n_shingles",
        "class_row",
        F.coalesce("least", "doc_id").alias("component_id"),
    )
