"""Every stage of the pipeline against a plain version of it, on the stage's own input."""

import os

import numpy as np
import pytest

import corpus_pipeline
from tablework.llm import language
from tests.llm import test_decontamination, test_exact, test_minhash, test_packing
from tests.llm.conftest import odd_rows


@pytest.fixture(scope="module")
def small(folder):
    return os.path.join(os.path.dirname(folder), "sf0.001")


def by_language(spark, docs, folder):
    model = language.fit(spark.createDataFrame(docs, SCHEMA)) if docs else None
    kept = []
    for row in docs:
        text = row["text"] or ""
        words = text.encode().translate(language._WORDS).split()
        if model is None or not words or not any(c.isalpha() for c in text):
            continue
        sums, count = np.zeros(len(model.languages)), 0
        for word in words:
            for start in range(0, len(word), language.LONGEST):
                run = np.frombuffer(b" " + word[start : start + language.LONGEST], np.uint8)[None]
                sums += model.probabilities(run)[0, 1:].sum(0)
                count += run.shape[1] - 1
        if sums.max() / count >= corpus_pipeline.MIN_SCORE:
            kept.append(row)
    return kept


def exact_dedup(spark, docs, folder):
    best = {}
    for row in docs:
        text = test_exact.plain(row["text"])
        if text not in best or _order(row) < _order(best[text]):
            best[text] = row
    return list(best.values())


def near_dedup(spark, docs, folder):
    _, roots = test_minhash.brute([(r["doc_id"], r["text"]) for r in docs], 5)
    best = {}
    for row, root in zip(docs, roots):
        if root not in best or _order(row) < _order(best[root]):
            best[root] = row
    return list(best.values())


def decontamination(spark, docs, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    return [r for r in docs if test_decontamination.brute([(1, r["text"])], items)[0][2] == 0]


def _order(row):
    return row["doc_id"] is None, row["doc_id"] or 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = {
    "language": by_language,
    "exact dedup": exact_dedup,
    "near dedup": near_dedup,
    "decontamination": decontamination,
}


def check(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, spark.createDataFrame(docs, SCHEMA), folder)
        if name not in PLAIN:
            test_packing.check(found.collect(), [(r["doc_id"], r["text"]) for r in docs])
            return docs
        assert found.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        found = [r.asDict() for r in found.collect()]
        # Of rows with one id and equal texts any one may be the one that stays.
        text = test_exact.plain if name == "exact dedup" else str
        got, want = (
            sorted(str((r["doc_id"], text(r["text"]), r["lang"])) for r in rows) for rows in (found, PLAIN[name](spark, docs, folder))
        )
        assert got == want, name
        docs = found


def rows_of(df):
    return [r.asDict() for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_on_a_table(spark, small):
    docs = rows_of(spark.read.parquet(f"{small}/documents.parquet"))
    last = check(spark, docs, small)
    assert 0.5 * len(docs) < len(last) < len(docs)


def test_stages_on_odd_rows(spark, small):
    docs = [dict(zip(SCHEMA.split()[::2], (i, t, "en" if t else None, None, None))) for i, t in odd_rows()]
    check(spark, docs, small)


def test_run_is_all_stages(spark, small):
    docs = rows_of(spark.read.parquet(f"{small}/documents.parquet"))
    for name, _ in corpus_pipeline.STAGES[:-1]:
        docs = PLAIN[name](spark, docs, small)
    test_packing.check(corpus_pipeline.run(spark, small).collect(), [(r["doc_id"], r["text"]) for r in docs])
