"""From raw documents to packed sequences, in stages that each read all their predecessor kept.

1. Language ID: documents without a letter, or of no language by ``MIN_SCORE``, go.
2. Exact dedup: one document of each text stays.
3. MinHash near-dedup: one document of each group of 0.8 or more on shingles of five words stays.
4. Benchmark decontamination: documents that share ten words in a row with a benchmark item go.
5. Best-fit packing: one row per piece of a document, with its place in a sequence.

All stages but the last return the columns of ``documents``, whose rows they keep as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablework.llm import common, decontamination, exact, language, minhash, packing
from tablework.llm.queries import table
from tablework.session import stage

# Below this mean probability of its letters a document is of no one language.
MIN_SCORE = 0.4


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ready(spark)
    model = language.fit(docs)
    return language.selected(docs, model, MIN_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ready(spark)
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ready(spark)
    return minhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ready(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.ready(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


# A trained network and a tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
