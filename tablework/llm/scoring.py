"""Scores of documents by a language model that mixes hashed-context bit predictors (see ``mixing`` and ``border``).

What the model knows of spelling comes from the corpus by way of its vocabulary: one pass counts all words of all texts
with the byte that comes next, and the words are cut, in order, into blocks. How often each byte followed each context is
a Spark table, keyed by the full hash of the context, which grows with the corpus; it is joined to the contexts of each
block. The bytes of a word so far mostly belong to one block only, which then counts them itself. The weights are learned
online in each block and then averaged. The bytes of a word after the first do not depend on other words, so their
probability is computed once per word of the vocabulary.

A document is then coded in order. How a word begins is predicted across the border, from the words and bytes before it
and from the document so far, and the document's own words are an alternative to spelling; weights, refinement and counts
change as it goes on. What followed each ending of three bytes, and the commonest words, at most ``COMMON``, go to every
task; those of the other words that a document has are joined to it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count, filterfalse, repeat
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import border as B
from tablework.llm import common as C
from tablework.llm import mixing as M
from tablework.llm.language import held_out
from tablework.session import discard, stage

COMMON = 65_536
# Words a task counts before it passes them on.
COUNTED = 300_000
# Words of so many bytes, or one longer word, make a block.
BLOCK_BYTES = 1 << 19
# Text of documents that are coded side by side. A longer one is coded alone.
SIDE_BYTES = 1 << 19


def _tokens(data, offsets):
    for a, b in zip(offsets, offsets[1:]):
        words = data[a:b].tobytes().lower().split()
        words.append(M.END)
        yield words


def _counted(batches):
    """How often each word stands in a part, and, as words of four bytes that ``follows`` tells apart, how often each
    byte that a word begins with follows each ending; the end is also before the first word."""
    learned, other, follows = Counter(), Counter(), Counter()

    def rows():
        words = list(learned.keys() | other.keys())
        columns = [list(map(counter.get, words, repeat(0))) for counter in (learned, other)]
        ends = [k.to_bytes(4, "big") for k in follows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([False] * len(words) + [True] * len(ends), pa.bool_()),
                pa.array(words + ends, pa.binary()),
                pa.array(columns[0] + list(follows.values()), pa.int64()),
                pa.array(columns[1] + [0] * len(ends), pa.int64()),
            ],
            ["follows", "word", "learned", "other"],
        )

    for batch, data, offsets in C.slices(batches):
        held = batch.column(batch.schema.get_field_index("held_out")).to_pylist()
        for away, words in zip(held, _tokens(data, offsets)):
            (other if away else learned).update(words)
        keys, n = np.unique(_followed(data, offsets, ~np.array(held)), return_counts=True)
        for k, c in zip(keys.tolist(), n.tolist()):
            follows[k] += c
        if len(learned) + len(other) > COUNTED:
            yield rows()
            learned.clear()
            other.clear()
            follows.clear()
    yield rows()


def _followed(data, offsets, taken) -> np.ndarray:
    """``ending * 256 + first byte`` for each token of the rows that are taken."""
    data = C.LOWER[data]
    starts, ends, rows = C.word_spans(data, offsets, C.SOLID)
    some = taken[rows]
    starts, ends, rows = starts[some], ends[some], rows[some]
    endings, begins = B.endings(data, starts, ends), data[starts].astype(np.int64)
    final = np.diff(rows, append=-1) != 0
    within = endings[:-1] * 256 + begins[1:]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    zero = B.endings(data, np.zeros(1, np.int64), np.zeros(1, np.int64))[0] * 256
    empty = np.full(int(taken.sum()) - len(first), zero + B.END)
    return np.concatenate([within[~final[:-1]], endings[final] * 256 + B.END, zero + begins[first], empty])


def _numbered(batches):
    """The rows of a part in order, with the number of their block."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        blocks = []
        for length in pc.binary_length(batch.column(0)).to_pylist():
            if size and size + length + 1 > BLOCK_BYTES:
                block, size = block + 1, 0
            size += length + 1
            blocks.append(block)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], ["block", *batch.schema.names])


def _borders(follows):
    """What a part's endings teach of how the word after them begins."""

    def run(batches):
        border = B.Border(*follows.value)
        weights, outcomes = B.first_weights(), np.zeros((B.REFINED, 2))
        squares, seen = np.full(weights.shape, 1e-3), np.zeros(B.GATES)
        for batch in batches:
            if len(batch):
                of, symbols, counts = (column.to_numpy() for column in batch.columns)
                B.learn(weights, squares, outcomes, seen, border, of, symbols, counts.astype(float))
        yield from _sums([_summed(weights, seen, outcomes)])

    return run


def _block(rows: pa.Table):
    """A block's rows in order, the block, and how often each of its words and steps was learned."""
    rows = rows.sort_by("word")
    counts = rows["learned"].to_numpy().astype(float)
    block = M.block(rows["word"].to_pylist())
    return rows, block, counts, M.step_weights(block, counts)


_STEPS = "block long, context long, held array<struct<byte:int,n:long>>"


def _steps(rows: pa.Table) -> pa.Table:
    """The contexts of a block that others may have too, with the bytes that followed them in it."""
    rows, block, _, taken = _block(rows)
    contexts, pairs, _ = block.followed
    counts = M.pair_counts(block, taken)
    kept = M.shared(block)
    pairs, counts = pairs[counts > 0], counts[counts > 0]
    pairs, counts = pairs[kept[pairs >> 8]], counts[kept[pairs >> 8]]
    sizes = np.bincount(pairs >> 8, minlength=len(contexts))[kept]
    held = pa.StructArray.from_arrays(
        [pa.array(pairs & 255, pa.int32()), pa.array(counts.astype(np.int64))], ["byte", "n"]
    )
    held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), held)
    number = pa.array(np.full(len(sizes), rows["block"][0].as_py()), pa.int64())
    return pa.table([number, pa.array(contexts[kept].view(np.int64)), held], ["block", "context", "held"])


def _with_table(rows: pa.Table, counts: pa.Table):
    """What ``_block`` gives, and the block's table: its own counts and those of contexts that others have too."""
    rows, block, learned, taken = _block(rows)
    contexts, pairs, _ = block.followed
    own, inner = M.pair_counts(block, taken), ~M.shared(block)[pairs >> 8]
    table = M.gathered(
        block,
        np.concatenate([contexts[pairs[inner] >> 8], counts["context"].to_numpy().view(np.uint64)]),
        np.concatenate([pairs[inner] & 255, counts["byte"].to_numpy()]),
        np.concatenate([own[inner], counts["n"].to_numpy()]),
    )
    return rows, block, learned, taken, table


def _learned(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's weights, by gate, with how many bits they come from, and its outcomes."""
    _, block, _, taken, table = _with_table(rows, counts)
    weights, outcomes = M.first_weights(), np.zeros((M.GATES * M.BUCKETS, 2))
    squares, seen = np.full(weights.shape, 1e-3), np.zeros(M.GATES)
    M.learn(table, weights, squares, outcomes, seen, block, taken)
    return pa.Table.from_batches([_summed(weights, seen, outcomes)])


def _summed(weights, seen, outcomes) -> pa.RecordBatch:
    values = np.concatenate([seen, (weights * seen[:, None]).ravel(), outcomes.ravel()])
    values = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
    return pa.RecordBatch.from_arrays([values], ["learned"])


def _averaged(sums: DataFrame, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and outcomes, from the sums by place; gates that nobody saw keep their ``first`` weights."""
    sums = sums.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    gates, inputs = first.shape
    values = np.zeros(gates * (1 + inputs + 2 * M.BUCKETS))
    values[sums["place"].to_numpy()] = sums["value"]
    seen, weights, outcomes = np.split(values, np.cumsum([gates, gates * inputs]))
    weights = weights.reshape(first.shape) / np.maximum(seen, 1e-9)[:, None]
    return np.where(seen[:, None] > 0, weights, first), outcomes.reshape(-1, 2)


def _sums(batches):
    """The sums of what the blocks of a part learned."""
    values = np.zeros(1)
    for batch in batches:
        values = values + np.stack(batch.column(0).to_numpy(zero_copy_only=False)).sum(0)
    places = np.flatnonzero(values)
    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(values[places])], ["place", "value"])


def _scored(mixer):
    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        weights, refined = mixer.value
        rows, block, _, _, table = _with_table(rows, counts)
        rest = M.rest_scores(table, weights, refined, block)
        return pa.table([rows["word"], rows["learned"], pa.array(rest, pa.float32())], ["word", "learned", "rest"])

    return run


def _rare(common):
    """The words of each document that are not among the common ones, numbered as they come."""

    def run(batches):
        held = set(common.value["word"].to_pylist())
        for batch, data, offsets in C.slices(batches):
            words, places, sizes = [], [], []
            for tokens in _tokens(data, offsets):
                some = list(filterfalse(held.__contains__, dict.fromkeys(tokens)))
                words.extend(some)
                places.extend(range(len(some)))
                sizes.append(len(some))
            number = pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64())
            columns = [number, pa.array(places, pa.int32()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "place", "word"])

    return run


def _documents(common, model):
    def run(batches):
        known = common.value.combine_chunks()
        held = dict(zip(known["word"].to_pylist(), range(len(known))))
        known = [known["learned"].to_numpy(), known["rest"].to_numpy()]
        follows, weights, refined, total = model.value
        lookup = B.Lookup(B.Border(*follows), weights, refined)
        for batch, data, offsets in C.slices(batches):
            begin = 0
            while begin < len(batch):
                end = int(np.searchsorted(offsets, offsets[begin] + SIDE_BYTES, "right")) - 1
                end = min(len(batch), max(end, begin + 1))
                some = batch.slice(begin, end - begin)
                yield _coded(some, data, offsets[begin : end + 1], held, known, lookup, total)
                begin = end

    return run


def _coded(batch, data, offsets, held, known, lookup, total):
    rare = batch.column(batch.schema.get_field_index("rest"))
    of = np.append(0, np.cumsum(rare.value_lengths().fill_null(0).to_numpy()))
    place, *rare = (column.to_numpy() for column in rare.flatten().flatten())
    # A document's words in the order in which it has them.
    at = np.empty(len(place), np.int64)
    at[np.repeat(of[:-1], np.diff(of)) + place] = np.arange(len(place))
    numbers = defaultdict(count().__next__)
    numbers[M.END]
    words, sizes = [], []
    for tokens in _tokens(data, offsets):
        words.extend(map(numbers.__getitem__, tokens))
        sizes.append(len(tokens))
    words, sizes = np.array(words, np.int64), np.array(sizes, np.int64)
    # The common words come first, then the others of these documents, in the order in which each document has them.
    number = np.fromiter(map(held.get, numbers, repeat(-1)), np.int64, len(numbers))
    earlier = B.earlier(sizes, words)
    others = words[(earlier == 0) & (number < 0)[words]]
    number[others] = len(known[0]) + np.arange(len(others))
    learned, rests = (np.concatenate([a, b[at]])[number] for a, b in zip(known, rare))
    limits = np.append(0, np.cumsum(np.fromiter(map(len, numbers), np.int64, len(numbers))))
    body = np.frombuffer(b"".join(numbers), np.uint8)
    ends = B.endings(body, limits[:-1], limits[1:])
    symbols = np.append(body, 0)[limits[:-1]]
    symbols[0] = B.END
    scores = B.document_scores(lookup, sizes, words, symbols[words], ends, rests, earlier)
    base = np.log10((learned + 0.1) / total)
    first = np.cumsum(sizes) - sizes
    columns = [
        batch.column(batch.schema.get_field_index("doc_id")),
        batch.column(batch.schema.get_field_index("held_out")),
        pa.array(np.diff(offsets), pa.int64()),
        pa.array(sizes),
        pa.array(np.add.reduceat((learned > 0)[words], first, dtype=np.int64)),
        pa.array(np.add.reduceat(base[words], first)),
        pa.array(scores),
    ]
    return pa.RecordBatch.from_arrays(columns, _SCORED)


_SCORED = ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score"]


def _frequent(vocabulary: DataFrame) -> DataFrame:
    """The words at or above a count that at most ``COMMON`` words reach, found from counts of counts."""
    size = F.floor(F.log2("n") * 16)
    rows = vocabulary.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()
    least, words = None, 0
    for row in sorted(rows, key=lambda r: -r["size"]):
        words += row["words"]
        if words > COMMON:
            break
        least = row["size"]
    return vocabulary.filter(size >= least) if least is not None else vocabulary.limit(0)


def scores(
    docs: DataFrame, parts: int = 10, part: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte``.

    The rows whose checksum of the id leaves ``part`` modulo ``parts`` are held out, all others are learned from, also
    those with a null id. A null or empty text has one token, its end. Both scores are log10 of the probability of
    the words in their order, A-Z in lower case, and the end. ``bits_per_byte`` is null for a text without bytes. Repeated rows are learned
    from and scored each. No rows in, no rows out; with nothing to learn from, every bit is even.
    """
    spark = docs.sparkSession
    source = C.texts(docs, id_column, text_column).withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    counted = source.mapInArrow(_counted, "follows boolean, word binary, learned long, other long")
    counted = counted.groupBy("follows", "word").agg(
        F.sum("learned").alias("learned"), (F.sum("learned") + F.sum("other")).alias("n")
    )
    # In order, so that words that begin alike share a block.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = stage(counted, "counted")
    vocabulary = counted.filter("not follows").drop("follows")
    vocabulary = vocabulary.repartitionByRange(width, "word").sortWithinPartitions("word")
    vocabulary = stage(vocabulary.mapInArrow(_numbered, "block long, word binary, learned long, n long"), "vocabulary")
    key = F.conv(F.hex("word"), 16, 10).cast("long")
    follows = counted.filter("follows").select(F.shiftright(key, 8).alias("ending"), (key % 256).alias("next"), "learned")
    follows = stage(follows.orderBy("ending", "next"), "follows")
    discard(counted)
    C.let_go(spark)
    totals = vocabulary.agg(
        F.coalesce(F.sum("learned"), F.lit(0)).alias("tokens"), F.count_if(F.col("learned") > 0).alias("words")
    ).first()

    blocks = vocabulary.select("block", "word", "learned").groupBy("block")
    steps = stage(blocks.applyInArrow(_steps, _STEPS), "steps")
    counts = steps.selectExpr("context", "inline(held)").groupBy("context", "byte").agg(F.sum("n").alias("n"))
    held = stage(steps.select("block", "context").join(counts, "context"), "counts")
    discard(steps)
    C.let_go(spark)
    blocks = blocks.cogroup(held.groupBy("block"))
    learned = stage(blocks.applyInArrow(_learned, "learned array<double>"), "learned")
    weights, outcomes = _averaged(learned.mapInArrow(_sums, "place int, value double"), M.first_weights())
    mixer = spark.sparkContext.broadcast((weights, M.refinement(outcomes)))

    # A row for each three bytes and a byte that follows them.
    held_follows = follows.orderBy("ending", "next").toArrow()
    held_follows = tuple(held_follows[name].to_numpy() for name in held_follows.schema.names)
    sums = follows.mapInArrow(_borders(spark.sparkContext.broadcast(held_follows)), "place int, value double")
    weights, outcomes = _averaged(sums, B.first_weights())
    total = totals["tokens"] + 0.1 * (totals["words"] + 1)
    model = spark.sparkContext.broadcast((held_follows, weights, B.refinement(outcomes), total))
    scored = blocks.applyInArrow(_scored(mixer), "word binary, learned long, rest float")
    scored = stage(scored, "scored")
    discard(held)
    C.let_go(spark)
    common = scored.join(F.broadcast(_frequent(vocabulary).select("word")), "word", "left_semi").toArrow()
    common = spark.sparkContext.broadcast(common)
    docs = C.identified(source, "row", "scores")
    rest = docs.select("row", "text").mapInArrow(_rare(common), "row long, place int, word binary")
    # Each word is scored once and they are spread evenly, so a part of them is a small hash table and nothing is sorted.
    rest = rest.join(scored.hint("shuffle_hash"), "word")
    rest = rest.groupBy("row").agg(F.collect_list(F.struct("place", "learned", "rest")).alias("rest"))
    docs = docs.join(rest, "row", "left").withColumn("rest", F.coalesce("rest", F.array().cast(rest.schema["rest"].dataType)))
    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"
    found = docs.select("doc_id", "held_out", "text", "rest").mapInArrow(_documents(common, model), schema)
    return found.select(
        *_SCORED[:5],
        F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
