"""Finding the rows of an index that are most similar to a question."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.columns import col
from tablework.functions.rows import pretty_json, row_json
from tablework.functions.vectors import SCORE_DIGITS, as_matrix, cosine_with
from tablework.operators.skew import salted_join
from tablework.operators.textindex import EVERY, GROUP, NORM, VECTOR, Embedder, embed_text, indexed_tables
from tablework.session import ship, stage

# --- fixed values: result sizes and texts of an answer ------------------------------------------
TOP_K = 5
TOP_K_ONE_TABLE = 10
CONTEXT_RECORDS = 5
CONTEXT_HEADER = "Based on the following data:\n\n"
NO_DATA = "No relevant data found. Please vectorize your tables first."
FOUND = "Here are the most relevant records for your question:"
# --- end of fixed values ------------------------------------------------------------------------

# The column of similarities to a pivot.
PIVOT = "pivot_similarity"

# The queries of a batch are sent to every task if they take no more memory than this.
QUERY_BYTES = 64 << 20
# Scores held at a time by one task, and rows of the index per cell of the grid.
_SCORES = 1 << 22
_CELL_ROWS = 100_000


def _check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


# ---- one question -------------------------------------------------------------------------------


def sparse_dot_with(vector: Column, buckets: list[int], weights: list[float]) -> Column:
    """Dot product of a sparse vector column with one fixed sparse vector."""
    order = np.argsort(buckets)
    wanted = np.asarray(buckets, dtype=np.int64)[order]
    factors = np.asarray(weights, dtype=np.float64)[order]

    @F.arrow_udf("double")
    def batch_dot(vectors: pa.Array) -> pa.Array:
        at, values, row = _sparse_cells(vectors)
        place, hit = _positions(at, wanted)
        total = np.bincount(row[hit], values[hit] * factors[place[hit]], minlength=len(vectors))
        return pa.array(total.astype(np.float64), pa.float64())

    return batch_dot(vector)


def similarity(vector: Column, norm: Column | None, query) -> Column:
    """Cosine similarity with one query vector, dense or sparse; null where a norm is zero."""
    if isinstance(query, (list, tuple, np.ndarray)) and not hasattr(query, "buckets"):
        return cosine_with(vector, query, norm)
    length = float(np.linalg.norm(query["weights"])) if query["weights"] else 0.0
    if length == 0:
        return F.lit(None).cast("double")
    score = sparse_dot_with(vector, query["buckets"], query["weights"]) / F.lit(length)
    if norm is not None:
        score = score / F.nullif(norm, F.lit(0.0))
    return F.round(score, SCORE_DIGITS)


def score(index: DataFrame, query, vector: str = VECTOR, norm: str | None = NORM) -> DataFrame:
    """``index`` without its vector columns, plus ``similarity`` (null where a vector is zero)."""
    ship(index.sparkSession)
    norm = norm if norm in index.columns else None
    value = similarity(col(vector), col(norm) if norm else None, query)
    rest = [col(c) for c in index.columns if c not in (vector, norm)]
    return index.select(*rest, value.alias("similarity"))


def _scored(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("similarity").isNotNull())


def search(
    index: DataFrame,
    query,
    key: str,
    k: int = TOP_K,
    vector: str = VECTOR,
    norm: str | None = NORM,
) -> DataFrame:
    """The ``k`` most similar rows; equal scores in the order of ``key``. Zero vectors are left out.

    They are dropped after the limit, where they stand last: a filter before it would be pushed below
    the score and compute every score twice.
    """
    _check_k(k)
    order = [F.desc_nulls_last("similarity"), col(key)]
    return _scored(score(index, query, vector, norm).orderBy(*order).limit(k))


def search_by_group(
    index: DataFrame,
    query,
    key: str,
    group: str,
    k: int = TOP_K,
    vector: str = VECTOR,
    norm: str | None = NORM,
) -> DataFrame:
    """The ``k`` most similar rows of each group. Every task keeps ``k`` rows per group before the
    shuffle, so a group of any size is cheap."""
    _check_k(k)
    window = Window.partitionBy(col(group)).orderBy(F.desc_nulls_last("similarity"), col(key))
    ranked = score(index, query, vector, norm).withColumn("rank", F.row_number().over(window))
    return _scored(ranked.filter(F.col("rank") <= k))


def search_pruned(
    index: DataFrame,
    query: list[float],
    key: str,
    pivot: list[float],
    k: int = TOP_K,
    vector: str = VECTOR,
) -> DataFrame:
    """``search`` for dense vectors whose similarity to ``pivot`` is stored with the index (see ``with_pivot``).

    Two angles bound the third: the similarity to the query lies between the cosines of the sum and of the difference
    of the angles that the pivot makes with either. The ``k``-th best lower bound, from the stored numbers alone, rules
    out all rows whose upper bound is below it; the others are scored. The result is that of ``search``.
    """
    _check_k(k)
    near = float(np.dot(query, pivot) / (np.linalg.norm(query) * np.linalg.norm(pivot)))
    angle, own = F.lit(float(np.arccos(np.clip(near, -1, 1)))), F.acos(F.col(PIVOT))
    # Stored similarities are rounded; the slack is far above what that can change.
    slack = 1e-4
    lowest = F.cos(F.least(angle + own, F.lit(np.pi))) - slack
    highest = F.cos(F.abs(angle - own)) + slack
    bounds = index.filter(F.col(PIVOT).isNotNull()).select(lowest.alias("lowest")).orderBy(F.desc("lowest")).limit(k)
    bar = bounds.agg(F.min("lowest")).first()[0]
    rows = index.filter(F.col(PIVOT).isNotNull())
    rows = rows.filter(highest >= bar) if bar is not None else rows
    return search(rows.drop(PIVOT), query, key, k, vector)


def with_pivot(index: DataFrame, pivot: list[float], vector: str = VECTOR) -> DataFrame:
    """``index`` with each row's similarity to ``pivot``, null for a zero vector."""
    ship(index.sparkSession)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_with(col(vector), pivot, None)))
    return index.withColumn(PIVOT, F.when(cosine_with(col(vector), pivot, None).isNotNull(), value))


def search_postings(postings: DataFrame, query, key: str, k: int = TOP_K) -> DataFrame:
    """``search`` on what ``store_postings`` wrote.

    Only the entries of the query's own buckets are read, and summed per row. If fewer than ``k`` rows share a word
    with the query, the first other rows by key follow with similarity 0, as they do in ``search``.
    """
    _check_k(k)
    columns = [col(key), F.lit(0.0).alias("similarity")]
    stored = postings.select("groups").first()
    if stored is None or not query["buckets"]:
        return postings.select(*columns).limit(0)
    groups = stored["groups"]
    length = float(np.linalg.norm(query["weights"]))
    wanted = [(b, w / length) for b, w in zip(query["buckets"], query["weights"])]
    spark = postings.sparkSession
    words = spark.createDataFrame(wanted, "_bucket int, _weight double")
    buckets = [b for b, _ in wanted]
    found = postings.filter(
        F.col(GROUP).isin(sorted({b % groups for b in buckets})) & F.col("bucket").isin(buckets)
    )
    value = F.round(F.sum(F.col("weight") * F.col("_weight")), SCORE_DIGITS)
    order = [F.desc("similarity"), col(key)]
    best = (
        found.join(words, F.col("bucket") == F.col("_bucket"))
        .groupBy(col(key))
        .agg(value.alias("similarity"))
        .orderBy(*order)
        .limit(k)
    )
    missing = k - best.count()
    if not missing:
        return best
    others = postings.filter((F.col(GROUP) == EVERY % groups) & (F.col("bucket") == EVERY)).select(*columns)
    others = others.join(best.select(col(key)), key, "left_anti").orderBy(col(key)).limit(missing)
    return best.unionByName(others).orderBy(*order)


# ---- many questions --------------------------------------------------------------------------------


def _sparse_cells(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, weights and row numbers of a batch of sparse vectors."""
    buckets, weights = (pc.struct_field(vectors, f) for f in ("buckets", "weights"))
    return (
        np.asarray(pc.list_flatten(buckets), dtype=np.int64),
        np.asarray(pc.list_flatten(weights), dtype=np.float64),
        np.asarray(pc.list_parent_indices(buckets), dtype=np.int64),
    )


def _positions(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the sorted ``wanted``, and which of them stand there at all."""
    if not len(wanted):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return place, wanted[place] == values


class _DenseQueries:
    def __init__(self, vectors: pa.Array):
        self.width = int(pc.max(vectors.value_lengths()).as_py() or 0)
        self.matrix, self.used = _unit_rows(*as_matrix(vectors, self.width))

    def scores(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores (rows x queries) of the rows that have a direction, and which rows these are."""
        rows, used = _unit_rows(*as_matrix(vectors, self.width))
        return rows @ self.matrix.T, used


def _unit_rows(matrix: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    keep = norms > 0
    return matrix[keep] / norms[keep, None], present[keep]


class _SparseQueries:
    """The queries by bucket: for each wanted bucket, which queries have it and with which weight."""

    def __init__(self, vectors: pa.Array):
        buckets, weights, row = _sparse_cells(vectors)
        norms = np.sqrt(np.bincount(row, weights * weights, minlength=len(vectors)))
        self.used = np.flatnonzero(norms > 0)
        order = np.argsort(buckets, kind="stable")
        self.wanted, first = np.unique(buckets[order], return_index=True)
        self.ends = np.append(first, len(buckets))
        self.column = np.searchsorted(self.used, row)[order]
        self.weight = (weights / norms[row])[order]

    def scores(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Only cells that share a bucket are computed, a bounded number of products at a time."""
        buckets, weights, row = _sparse_cells(vectors)
        norms = np.sqrt(np.bincount(row, weights * weights, minlength=len(vectors)))
        used = np.flatnonzero(norms > 0)
        width = len(self.used)
        place, hit = _positions(buckets, self.wanted)
        place, row, value = place[hit], row[hit], (weights / norms[row])[hit]
        count = self.ends[place + 1] - self.ends[place]
        total = np.cumsum(count)
        out = np.zeros(len(vectors) * width)
        start = 0
        while start < len(place):
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + _SCORES, side="right")))
            part = slice(start, stop)
            entry = np.repeat(np.arange(start, stop), count[part])
            before = np.repeat(total[part] - count[part] - done, count[part])
            other = self.ends[place[entry]] + np.arange(len(entry)) - before
            cell = row[entry] * width + self.column[other]
            out += np.bincount(cell, value[entry] * self.weight[other], minlength=len(out))
            start = stop
        return out.reshape(len(vectors), width)[used], used


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each column: column, row and score; ties in the order of ``keys``."""
    count = len(scores)
    if count > k:
        bar = np.partition(scores, count - k, axis=0)[count - k]
        row, column = np.nonzero(scores >= bar)
    else:
        row, column = (a.ravel() for a in np.indices(scores.shape))
    value = scores[row, column]
    rank = np.empty(count, dtype=np.int64)
    rank[np.argsort(keys, kind="stable")] = np.arange(count)
    order = np.lexsort((rank[row], -value, column))
    column, row, value = column[order], row[order], value[order]
    place = np.arange(len(column)) - np.searchsorted(column, column)
    keep = place < k
    return column[keep], row[keep], value[keep]


def _matcher(ids: pa.Array, queries: _DenseQueries | _SparseQueries, schema: pa.Schema, k: int):
    """A function from a batch ``(key, vector)`` of the index to its best hits per query."""
    ids = ids.take(pa.array(queries.used))

    def match(keys: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        step = max(k, _SCORES // max(1, len(ids)))
        for start in range(0, len(keys), step):
            part_keys, part = keys.slice(start, step), vectors.slice(start, step)
            scores, used = queries.scores(part)
            part_keys = part_keys.take(pa.array(used))
            scores = np.round(scores, SCORE_DIGITS)
            column, row, value = _best(scores, part_keys.to_numpy(zero_copy_only=False), k)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(column)), part_keys.take(pa.array(row)), pa.array(value)],
                schema=schema,
            )

    return match


def _queries_of(vectors: pa.Array) -> _DenseQueries | _SparseQueries:
    return _SparseQueries(vectors) if pa.types.is_struct(vectors.type) else _DenseQueries(vectors)


def _trim(hits: list[pa.RecordBatch], k: int) -> pa.Table:
    """The ``k`` best hits per query of several batches."""
    table = pa.Table.from_batches(hits)
    query, key, value = table.column_names
    table = table.sort_by([(query, "ascending"), (value, "descending"), (key, "ascending")])
    codes = table[query].combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.arange(len(codes)) - np.searchsorted(codes, codes)
    return table.filter(pa.array(place < k))


def search_many(
    index: DataFrame,
    queries: DataFrame,
    key: str,
    query_key: str,
    k: int = TOP_K,
    vector: str = VECTOR,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``k`` best rows of ``index`` for every row of ``queries``: ``(query_key, key, similarity)``.

    Both frames have a vector column of the same kind. Similarities are computed block by block inside
    the tasks, and each task passes on only its best ``k`` rows per query: the pairs never become rows.
    Queries that take at most ``query_bytes`` go to every task, and the index is not shuffled. Beyond
    that, both sides are dealt out to the cells of a grid, so that neither has to fit one machine.
    """
    _check_k(k)
    ship(index.sparkSession)
    index = index.select(col(key), col(vector).alias(VECTOR))
    # Written out once: their size is taken before it is decided where they go.
    queries = stage(queries.select(col(query_key), col(vector).alias(VECTOR)), "queries")
    schema = T.StructType(
        [queries.schema[query_key], index.schema[key], T.StructField("similarity", T.DoubleType())]
    )
    size = F.size(VECTOR) if _is_dense(queries) else 2 * F.size(f"{VECTOR}.buckets")
    named = F.coalesce(F.octet_length(col(query_key).cast("string")), F.lit(0))
    needed = queries.agg(F.sum(8 * size + 16 + named).alias("bytes")).first()["bytes"] or 0
    if needed <= query_bytes:
        hits = _match_everywhere(index, queries, schema, k)
    else:
        hits = _match_in_grid(index, queries, schema, k, math.ceil(needed / query_bytes))
    window = Window.partitionBy(col(query_key)).orderBy(F.desc("similarity"), col(key))
    return hits.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


def _is_dense(df: DataFrame) -> bool:
    return isinstance(df.schema[VECTOR].dataType, T.ArrayType)


def _match_everywhere(
    index: DataFrame, queries: DataFrame, schema: T.StructType, k: int
) -> DataFrame:
    small = queries.toArrow().combine_chunks()
    arrow = _arrow_schema(schema)
    ids, vectors = (_one_array(small, i) for i in range(2))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(ids, _queries_of(vectors), arrow, k)
        held: list[pa.RecordBatch] = []
        limit = _SCORES
        for batch in batches:
            held.extend(match(batch.column(0), batch.column(1)))
            if sum(len(h) for h in held) > limit:
                kept = _trim(held, k)
                held, limit = kept.to_batches(), max(_SCORES, 2 * len(kept))
        if held:
            yield from _trim(held, k).to_batches()

    return index.mapInArrow(best, schema)


def _match_in_grid(
    index: DataFrame, queries: DataFrame, schema: T.StructType, k: int, blocks: int
) -> DataFrame:
    parts = max(1, math.ceil(index.count() / _CELL_ROWS))
    arrow = _arrow_schema(schema)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # By the whole row, so that rows of one key, or of none, spread too.
        mine = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(n)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.withColumn(own, mine).withColumn(other, every)

    def cell(_, rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(wanted) or not len(rows):
            return arrow.empty_table()
        ids, vectors = (_one_array(wanted, i) for i in range(2))
        match = _matcher(ids, _queries_of(vectors), arrow, k)
        held = list(match(_one_array(rows, 0), _one_array(rows, 1)))
        return _trim(held, k) if held else arrow.empty_table()

    left = dealt(index, "_part", parts, "_block", blocks).groupBy("_part", "_block")
    right = dealt(queries, "_block", blocks, "_part", parts).groupBy("_part", "_block")
    return left.cogroup(right).applyInArrow(cell, schema)


def _one_array(table: pa.Table, i: int) -> pa.Array:
    column = table.column(i).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.StringType: pa.string(),
        T.DoubleType: pa.float64(),
    }
    for field in schema.fields:
        if type(field.dataType) not in kinds:
            raise ValueError(f"{field.name} must be a whole number or text")
    return pa.schema([pa.field(f.name, kinds[type(f.dataType)]) for f in schema.fields])


# ---- several tables, answers -----------------------------------------------------------------------


def search_tables(
    indexes: dict[str, tuple[DataFrame, str]], query, k: int = TOP_K
) -> DataFrame:
    """The ``k`` best rows of every index: ``(table_position, table_name, key, data, similarity)``.

    ``indexes`` maps a table name to its index and the name of its key column.
    """
    _check_k(k)
    if not indexes:
        raise LookupError("no table is indexed")
    hits = [_table_hits(n, name, index, key, query, k) for n, (name, (index, key)) in enumerate(indexes.items())]
    return reduce(DataFrame.unionByName, hits)


def _table_hits(position: int, name: str, index: DataFrame, key: str, query, k: int) -> DataFrame:
    source = [c for c in index.columns if c not in (VECTOR, NORM)]
    return search(index, query, key, k).select(
        F.lit(position).alias("table_position"),
        F.lit(name).alias("table_name"),
        col(key).cast("string").alias("key"),
        row_json(source).alias("data"),
        "similarity",
    )


def search_stored(spark: SparkSession, question: str, tables: list[str] | None = None, k: int = TOP_K) -> DataFrame:
    """``search_tables`` over stored indexes, each asked by its own model: those of ``tables``, or all there are."""
    _check_k(k)
    indexes = indexed_tables(spark)
    for name in tables or ():
        if name not in indexes:
            raise LookupError(f"table {name} is not indexed")
    chosen = [indexes[name] for name in tables or sorted(indexes)]
    if not chosen:
        raise LookupError("no table is indexed")
    hits = [
        _table_hits(n, i.source, i.frame(spark), i.key, embed_text(spark, question, i.model(spark)), k)
        for n, i in enumerate(chosen)
    ]
    return reduce(DataFrame.unionByName, hits)


def first_hits(hits: DataFrame, n: int = CONTEXT_RECORDS, rerank: bool = False) -> DataFrame:
    """The first ``n`` hits, table by table; with ``rerank`` the best ``n`` of all tables."""
    order = [F.desc("similarity"), F.col("key")]
    return hits.orderBy(*(order if rerank else [F.col("table_position"), *order])).limit(n)


def context(hits: DataFrame, n: int = CONTEXT_RECORDS, rerank: bool = False) -> DataFrame:
    """One row ``(context, source_data)``: the first ``n`` hits as numbered JSON records."""
    place = F.lit(0) if rerank else F.col("table_position")
    entry = F.struct(
        place.alias("place"),
        (-F.col("similarity")).alias("order"),
        "key",
        "data",
        pretty_json("data").alias("text"),
        "similarity",
    )
    top = first_hits(hits, n, rerank).agg(F.sort_array(F.collect_list(entry)).alias("hits"))
    return top.select(*_context_of("hits"))


def _context_of(hits: str) -> list[Column]:
    """Columns ``context`` and ``source_data`` of a column of ordered hits."""
    blocks = F.transform(
        hits,
        lambda h, i: F.concat(
            F.lit("Record "), (i + 1).cast("string"), F.lit(": "), h["text"], F.lit("\n\n")
        ),
    )
    source = F.transform(
        hits, lambda h: F.struct(h["data"].alias("data"), h["similarity"].alias("similarity"))
    )
    return [
        F.concat(F.lit(CONTEXT_HEADER), F.array_join(blocks, "")).alias("context"),
        source.alias("source_data"),
    ]


def ask_many(
    index: DataFrame, questions: DataFrame, key: str, question_key: str, n: int = CONTEXT_RECORDS
) -> DataFrame:
    """For every row of ``questions``: ``(question_key, context, source_data)`` from its ``n`` best rows.

    The hits, at most ``n`` per question, are written out once and then joined to their rows; a row that very
    many questions hit is spread over the tasks.
    """
    hits = stage(search_many(index, questions, key, question_key, n), "hits")
    source = [c for c in index.columns if c not in (VECTOR, NORM)]
    rows = index.select(col(key).alias("_key"), row_json(source).alias("data"))
    found = salted_join(hits, rows, key, "_key", "inner")
    entry = F.struct(
        (-F.col("similarity")).alias("order"),
        col(key).alias("key"),
        "data",
        pretty_json("data").alias("text"),
        "similarity",
    )
    return (
        found.groupBy(col(question_key))
        .agg(F.sort_array(F.collect_list(entry)).alias("hits"))
        .select(col(question_key), *_context_of("hits"))
    )


def ask(
    question: str,
    indexes: dict[str, tuple[DataFrame, str]],
    embedder: Embedder,
    table: str | None = None,
    rerank: bool = False,
    answer: Callable[[str, str], str] | None = None,
) -> dict:
    """Answer one question from the indexed tables, or from one of them.

    ``answer`` gets the context and the question; without it, or if it fails, the answer is a fixed
    sentence. The at most five source records come with it.
    """
    if table is not None and table not in indexes:
        raise LookupError(f"table {table} is not indexed")
    if not indexes:
        return {"answer": NO_DATA, "source_data": []}
    spark = next(iter(indexes.values()))[0].sparkSession
    query = embed_text(spark, question, embedder)
    if table is None:
        hits = search_tables(indexes, query, TOP_K)
    else:
        hits = search_tables({table: indexes[table]}, query, TOP_K_ONE_TABLE)
    return _answered(question, hits, rerank, answer)


def ask_stored(
    spark: SparkSession,
    question: str,
    table: str | None = None,
    rerank: bool = False,
    answer: Callable[[str, str], str] | None = None,
) -> dict:
    """``ask`` over all stored indexes, or one of them."""
    if table is None and not indexed_tables(spark):
        return {"answer": NO_DATA, "source_data": []}
    k = TOP_K if table is None else TOP_K_ONE_TABLE
    hits = search_stored(spark, question, None if table is None else [table], k)
    return _answered(question, hits, rerank, answer)


def _answered(
    question: str, hits: DataFrame, rerank: bool, answer: Callable[[str, str], str] | None
) -> dict:
    found = context(hits, rerank=rerank).first()
    records = [r.asDict() for r in found["source_data"]]
    if not records:
        return {"answer": NO_DATA, "source_data": []}
    text = FOUND
    if answer is not None:
        try:
            text = answer(found["context"], question)
        except Exception as failure:  # any failure of the answering service leaves the records
            print(f"answering failed: {failure}")
    return {"answer": text, "context": found["context"], "source_data": records}
