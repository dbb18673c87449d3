"""Vector indexes over chosen text columns of a table.

An index is the table itself plus two columns: ``vector`` and ``norm``. There are two kinds of vectors:

* dense, ``array<float>``, from a model that the caller supplies (``ModelEmbedder``);
* sparse, ``struct<buckets array<int>, weights array<double>>``, from ``HashedTfIdf``. It needs no model, and
  it matches words, not meaning.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.columns import col, quoted_table
from tablework.functions.rows import combined_text
from tablework.functions.vectors import l2_norm
from tablework.session import ship

VECTOR, NORM = "vector", "norm"
GROUP = "bucket_group"

_BUCKETS = T.ArrayType(T.IntegerType())
_COUNTS = T.StructType(
    [T.StructField("buckets", _BUCKETS), T.StructField("counts", T.ArrayType(T.IntegerType()))]
)
_SPARSE = T.StructType(
    [T.StructField("buckets", _BUCKETS), T.StructField("weights", T.ArrayType(T.DoubleType()))]
)


class Embedder(Protocol):
    def vector(self, text: Column) -> Column:
        """The vector of a text column."""

    def norm(self, vector: Column) -> Column:
        """The norm of such a vector."""


def build_index(df: DataFrame, text_columns: list[str], embedder: Embedder) -> DataFrame:
    """All rows and columns of ``df`` with the vector of its chosen text columns, and its norm."""
    ship(df.sparkSession)
    vectors = df.withColumn(VECTOR, embedder.vector(combined_text(text_columns)))
    return vectors.withColumn(NORM, embedder.norm(F.col(VECTOR)))


def vectorize_table(
    spark: SparkSession, table: str, text_columns: list[str], embedder: Embedder, target: str
) -> int:
    """Build the index of ``table``, store it as the table ``target`` and return its row count."""
    build_index(spark.table(table), text_columns, embedder).write.mode("overwrite").saveAsTable(target)
    return spark.table(target).count()


# ---- stored indexes --------------------------------------------------------------------------------

_PROPERTIES = ("source", "key", "text_columns")


@dataclass(frozen=True)
class StoredIndex:
    """An index table with what is needed to search it: its source, key and text columns. The state of its model is in
    a table beside it."""

    target: str
    source: str
    key: str
    text_columns: list[str]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.target)

    def model(self, spark: SparkSession) -> HashedTfIdf:
        row = spark.table(_model_table(self.target)).first()
        return HashedTfIdf(np.array(row["idf"]), row["rows"])


def _model_table(target: str) -> str:
    return f"{target}_model"


def store_index(
    spark: SparkSession,
    table: str,
    text_columns: list[str],
    key: str,
    target: str | None = None,
    dim: int = 1 << 18,
    path: str | None = None,
) -> int:
    """Index the words of a table's text columns and store the index so that any session can search it; its row count.

    The model is fitted to the table and stored with the index: one row of ``dim`` numbers.
    """
    target = target or f"{table}_index"
    rows = spark.table(table)
    model = HashedTfIdf.fit(rows, text_columns, dim)
    index = build_index(rows, text_columns, model).write.mode("overwrite").format("parquet")
    state = spark.createDataFrame([(model.idf.tolist(), model.rows)], "idf array<double>, rows bigint")
    state = state.write.mode("overwrite").format("parquet")
    if path:
        index, state = index.option("path", path), state.option("path", f"{path}_model")
    state.saveAsTable(_model_table(target))
    index.saveAsTable(target)
    values = (table, key, json.dumps(text_columns))
    properties = ", ".join(f"'tablework.index.{p}'='{_escaped(v)}'" for p, v in zip(_PROPERTIES, values))
    spark.sql(f"ALTER TABLE {quoted_table(target)} SET TBLPROPERTIES ({properties})")
    return spark.table(target).count()


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def stored_index(spark: SparkSession, target: str) -> StoredIndex | None:
    """What a table says about itself, or None if it is no index."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted_table(target)}").collect()
    found = {r["key"]: r["value"] for r in rows}
    values = [found.get(f"tablework.index.{p}") for p in _PROPERTIES]
    if None in values:
        return None
    return StoredIndex(target, values[0], values[1], json.loads(values[2]))


def indexed_tables(spark: SparkSession) -> dict[str, StoredIndex]:
    """The indexed tables of the current database with their indexes, by name."""
    targets = sorted(t.name for t in spark.catalog.listTables() if t.tableType in ("MANAGED", "EXTERNAL"))
    found = [stored_index(spark, t) for t in targets]
    return {i.source: i for i in found if i is not None}


def embed_text(spark: SparkSession, text: str, embedder: Embedder):
    """The vector of one string: a list of floats, or a row of buckets and weights."""
    ship(spark)
    return spark.range(1).select(embedder.vector(F.lit(text)).alias(VECTOR)).first()[VECTOR]


# ---- dense vectors from a supplied model -------------------------------------------------------


@dataclass(frozen=True)
class ModelEmbedder:
    """Dense vectors from a model: ``load`` is called once per Python worker and returns a function
    from an array of texts to an array of vectors."""

    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    batch_size: int = 64

    def vector(self, text: Column) -> Column:
        predict = predict_batch_udf(
            self.load, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_size
        )
        return predict(text)

    def norm(self, vector: Column) -> Column:
        return l2_norm(vector)


# ---- sparse vectors of hashed words --------------------------------------------------------------


def _words(text: pa.Array) -> pa.Array:
    """Lower-case words between white space."""
    return pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(text, "")))


def bucket_of_token(token: str, dim: int) -> int:
    """The first 28 bits of the MD5 sum, modulo ``dim``."""
    return (int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") >> 4) % dim


def _count_buckets(text: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers and counts of a batch of texts, row after row, and where each row starts.

    Each distinct word of the batch is hashed once; all rows are counted by one sort.
    """
    words = _words(text)
    rows = np.asarray(pc.list_parent_indices(words), dtype=np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashed = np.array([bucket_of_token(w, dim) if w else -1 for w in distinct], dtype=np.int64)
    buckets = hashed[np.asarray(coded.indices)] if len(rows) else rows
    cells = (rows * dim + buckets)[buckets >= 0]
    cells, counts = np.unique(cells, return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(text) + 1, dtype=np.int64) * dim)
    return cells % dim, counts, starts


def _lists(values: np.ndarray, kind: pa.DataType, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def bucket_counts(text: Column, dim: int) -> Column:
    """How often each bucket occurs in a text: ``struct<buckets, counts>``, ordered by bucket.

    A text is counted within its own task, so its words are never shuffled.
    """

    @F.arrow_udf(_COUNTS)
    def count(texts: pa.Array) -> pa.Array:
        buckets, counts, starts = _count_buckets(texts, dim)
        return pa.StructArray.from_arrays(
            [_lists(buckets, pa.int32(), starts), _lists(counts, pa.int32(), starts)],
            ["buckets", "counts"],
        )

    return count(text)


@dataclass(frozen=True, eq=False)
class HashedTfIdf:
    """Hashed tf-idf vectors of length one (or zero, for a text without words).

    ``idf`` has one number per bucket: two megabytes at the default ``dim``, however large the table.
    """

    idf: np.ndarray
    rows: int

    @property
    def dim(self) -> int:
        return len(self.idf)

    @classmethod
    def fit(cls, df: DataFrame, text_columns: list[str], dim: int = 1 << 18) -> HashedTfIdf:
        """One pass over the texts. A task combines its rows to at most ``dim`` sums, and ``dim`` sums
        reach the driver."""
        ship(df.sparkSession)
        buckets = bucket_counts(combined_text(text_columns), dim)["buckets"]
        # Bucket -1 occurs once in every row and so counts the rows in the same pass.
        seen = df.select(F.explode(F.concat(F.array(F.lit(-1)), buckets)).alias("bucket"))
        found = seen.groupBy("bucket").count().toArrow()
        where = np.asarray(found["bucket"], dtype=np.int64)
        how_often = np.asarray(found["count"], dtype=np.int64)
        rows = int(how_often[where < 0].sum())
        frequency = np.zeros(dim, dtype=np.int64)
        frequency[where[where >= 0]] = how_often[where >= 0]
        return cls(np.log((1 + rows) / (1 + frequency)) + 1, rows)

    def vector(self, text: Column) -> Column:
        dim, idf = self.dim, self.idf

        @F.arrow_udf(_SPARSE)
        def weigh(texts: pa.Array) -> pa.Array:
            buckets, counts, starts = _count_buckets(texts, dim)
            weights = counts * idf[buckets]
            row = np.repeat(np.arange(len(texts)), np.diff(starts))
            norms = np.sqrt(np.bincount(row, weights * weights, minlength=len(texts)))
            weights = weights / norms[row]
            return pa.StructArray.from_arrays(
                [_lists(buckets, pa.int32(), starts), _lists(weights, pa.float64(), starts)],
                ["buckets", "weights"],
            )

        return weigh(text)

    def norm(self, vector: Column) -> Column:
        return F.when(F.size(vector["buckets"]) > 0, 1.0).otherwise(0.0)


# The bucket of all rows in stored postings.
EVERY = -1


def postings(index: DataFrame, key: str) -> DataFrame:
    """A sparse index as rows ``(key, bucket, weight)``."""
    entry = F.arrays_zip(F.col(VECTOR)["buckets"], F.col(VECTOR)["weights"])
    return index.select(col(key), F.explode(entry).alias("entry")).select(
        col(key),
        F.col("entry")["buckets"].alias("bucket"),
        F.col("entry")["weights"].alias("weight"),
    )


def store_postings(index: DataFrame, key: str, path: str, groups: int = 1024) -> None:
    """Write a sparse index turned round: folders by bucket, and rows in the order of buckets within a file.

    A search then reads the few folders and row groups of its own words. A bucket that very many rows have is
    written by several tasks. Into how many groups it is divided is written with the rows. Every row that has words
    also stands under the bucket ``EVERY``, without weight, for searches that find fewer rows than they want.
    """
    every = index.filter(F.size(F.col(VECTOR)["buckets"]) > 0).select(
        col(key), F.lit(EVERY).alias("bucket"), F.lit(0.0).alias("weight")
    )
    rows = postings(index, key).unionByName(every)
    rows = rows.withColumn(GROUP, F.pmod("bucket", F.lit(groups))).withColumn("groups", F.lit(groups))
    (
        rows.hint("rebalance", GROUP)
        .sortWithinPartitions(GROUP, "bucket")
        .write.partitionBy(GROUP)
        .parquet(path)
    )
