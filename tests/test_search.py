import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablework.functions import rows as R
from tablework.functions import vectors as V
from tablework.operators import search as S
from tablework.operators import textindex as X


@pytest.fixture(scope="module")
def embeddings(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet").withColumnRenamed("embedding", "vector")


@pytest.fixture(scope="module")
def first(embeddings):
    return embeddings.filter("vec_id = 0").first()["vector"]


TEXTS = [(1, "red green blue", "a"), (2, "red red green", "b"), (3, "yellow", None), (4, None, "c"), (5, " ", "d")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string, tag string")


def hits(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_known_neighbours(embeddings, first):
    found = hits(S.search(embeddings, first, "vec_id"), "vec_id", F.round("similarity", 6))
    assert found == [(0, 1.0), (365, 0.369994), (334, 0.362722), (387, 0.331139), (423, 0.296934)]


VECTORS = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [-1.0, 0.0])]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(VECTORS, "id int, vector array<float>")


def test_zero_vectors_drop_and_ties_go_by_key(small):
    found = hits(S.search(small, [1.0, 0.0], "id", 99), "id", "similarity")
    assert found == [(1, 1.0), (3, 1.0), (4, 0.0), (6, -1.0)]
    assert S.search(small, [0.0, 0.0], "id").count() == 0


def test_stored_norm_gives_the_same(small):
    stored = small.withColumn("norm", V.l2_norm(F.col("vector")))
    assert hits(S.search(stored, [1.0, 1.0], "id"), "id", "similarity") == hits(
        S.search(small, [1.0, 1.0], "id"), "id", "similarity"
    )


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(small, k):
    for call in (
        lambda: S.search(small, [1.0, 0.0], "id", k),
        lambda: S.search_by_group(small, [1.0, 0.0], "id", "id", k),
        lambda: S.search_many(small, small.withColumnRenamed("id", "q"), "id", "q", k),
        lambda: S.search_pruned(small, [1.0, 0.0], "id", [1.0, 0.0], k),
        lambda: S.search_tables({"a": (small, "id")}, [1.0, 0.0], k),
    ):
        with pytest.raises(ValueError):
            call()


def test_wrong_width_is_an_error(small):
    with pytest.raises(Exception, match="must all have 3 elements"):
        S.search(small, [1.0, 0.0, 0.0], "id").collect()


def test_expression_equals_batch_form(embeddings, first):
    query = F.array(*[F.lit(float(x)) for x in first])
    both = embeddings.select(
        V.cosine(F.col("vector"), query).alias("a"), V.cosine_with(F.col("vector"), first).alias("b")
    )
    assert both.filter(F.abs(F.col("a") - F.col("b")) > 1e-8).count() == 0


def brute(index, queries, k):
    out = set()
    for q, qv in queries:
        scored = []
        for i, v in index:
            if v is None or not any(v) or qv is None or not any(qv):
                continue
            a, b = np.array(v, float), np.array(qv, float)
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), i))
        out |= {(q, i) for _, i in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize("limit", [S.QUERY_BYTES, 64])
def test_many_questions_against_brute_force(spark, limit):
    """Both ways, with a third of the rows being copies of one vector, so that ties have to be cut."""
    rng = np.random.default_rng(7)
    index = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(200)]
    index += [(900, [0.0, 0.0, 0.0]), (901, None)]
    queries = [(f"q{i}", rng.normal(size=3).tolist()) for i in range(7)]
    queries += [("copy", [2.0, 4.0, 6.0]), ("zero", [0.0, 0.0, 0.0])]
    found = S.search_many(
        spark.createDataFrame(index, "id int, vector array<double>").repartition(5),
        spark.createDataFrame(queries, "q string, vector array<double>"),
        "id",
        "q",
        4,
        query_bytes=limit,
    )
    rows = found.collect()
    assert {(r.q, r.id) for r in rows} == brute(index, queries, 4)
    assert Counter(r.q for r in rows) == {q: 4 for q, _ in queries if q != "zero"}


def test_scores_are_cut_into_pieces(spark, embeddings, first, monkeypatch):
    queries = embeddings.limit(20).withColumnRenamed("vec_id", "q")
    whole = sorted(hits(S.search_many(embeddings, queries, "vec_id", "q"), "q", "vec_id", "similarity"))
    monkeypatch.setattr(S, "_CELL_ROWS", 100)
    grid = S.search_many(embeddings, queries, "vec_id", "q", query_bytes=2000)
    assert sorted(hits(grid, "q", "vec_id", "similarity")) == whole


def test_no_questions(spark, embeddings):
    none = embeddings.limit(0).withColumnRenamed("vec_id", "q")
    assert S.search_many(embeddings, none, "vec_id", "q").count() == 0


@pytest.mark.parametrize("row", [0, 7, 100])
def test_pruned_search_is_exact(embeddings, first, row):
    pivot = embeddings.filter(f"vec_id = {row}").first()["vector"]
    index = S.with_pivot(embeddings, pivot)
    for k in (1, 10, 5000):
        whole = hits(S.search(embeddings, first, "vec_id", k), "vec_id", "similarity")
        assert hits(S.search_pruned(index, first, "vec_id", pivot, k), "vec_id", "similarity") == whole


# ---- text ------------------------------------------------------------------------------------------


def test_tfidf_by_hand(texts):
    model = X.HashedTfIdf.fit(texts, ["text"], dim=1 << 18)
    assert model.rows == 5
    index = {r.id: r for r in X.build_index(texts, ["text"], model).collect()}
    assert len(index) == 5
    words = {"red": 2, "green": 2, "blue": 1}
    idf = {w: math.log(6 / (1 + n)) + 1 for w, n in words.items()}
    raw = {X.bucket_of_token(w, 1 << 18): idf[w] for w in words}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    weights = dict(zip(index[1].vector.buckets, index[1].vector.weights))
    assert weights == pytest.approx({b: w / norm for b, w in raw.items()})
    assert index[4].vector.buckets == [] and (index[4].norm, index[1].norm) == (0.0, 1.0)
    assert index[5].vector.buckets == [] and index[1].tag == "a"


def test_text_search(spark, texts):
    model = X.HashedTfIdf.fit(texts, ["text"])
    index = X.build_index(texts, ["text"], model)
    query = X.embed_text(spark, "RED  green", model)
    found = hits(S.search(index, query, "id", 2), "id")
    assert found == [(2,), (1,)]
    none = X.embed_text(spark, "", model)
    assert S.search(index, none, "id").count() == 0
    questions = spark.createDataFrame([(1, "yellow"), (2, "nothing known")], "q int, text string")
    asked = X.build_index(questions, ["text"], model)
    many = S.search_many(index, asked, "id", "q", 1)
    best = {r.q: (r.id, r.similarity) for r in many.collect()}
    assert best[1] == (3, 1.0) and best[2][1] == 0.0


@pytest.mark.parametrize("products", [1 << 22, 5])
@pytest.mark.parametrize("limit", [S.QUERY_BYTES, 200])
def test_sparse_questions_against_brute_force(spark, monkeypatch, products, limit):
    """Scores of a third of copies, of words that nearly all rows have, and of products cut anywhere."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = [
        (i, "the same copy of w1 w2" if i % 3 == 0 else "the " + " ".join(rng.choice(words, 6)))
        for i in range(60)
    ] + [(99, " ")]
    asked = [(i, "the " + " ".join(rng.choice(words, 3))) for i in range(9)] + [(50, ""), (51, "unknown")]
    texts = spark.createDataFrame(rows, "id int, text string")
    model = X.HashedTfIdf.fit(texts, ["text"])
    index = X.build_index(texts, ["text"], model)
    questions = X.build_index(spark.createDataFrame(asked, "q int, text string"), ["text"], model)
    if products == 5:  # in this process, where the setting can be seen
        monkeypatch.setattr(S, "_SCORES", products)
        vectors = questions.orderBy("q").select("vector").toArrow().column(0).combine_chunks()
        queries = S._SparseQueries(vectors)
        table = index.orderBy("id").select("vector").toArrow().column(0).combine_chunks()
        scores, used = queries.scores(table)
        dense = [np.zeros((len(v), model.dim)) for v in (vectors, table)]
        for matrix, column in zip(dense, (vectors, table)):
            for i, v in enumerate(column.to_pylist()):
                matrix[i, v["buckets"]] = v["weights"]
        assert np.allclose(scores, (dense[1] @ dense[0].T)[np.ix_(used, queries.used)])
        return
    found = S.search_many(index, questions, "id", "q", 4, query_bytes=limit)
    got = {q: [] for q, _ in asked}
    for r in found.orderBy("q", F.desc("similarity"), "id").collect():
        got[r.q].append((r.id, r.similarity))
    for q, text in asked:
        single = S.search(index, X.embed_text(spark, text, model), "id", 4)
        assert got[q] == [(r.id, r.similarity) for r in single.collect()]


def test_index_as_table(spark, texts, name):
    texts.createOrReplaceTempView("texts_of_test")
    model = X.HashedTfIdf.fit(texts, ["text"])
    assert X.vectorize_table(spark, "texts_of_test", ["text", "tag"], model, name) == 5
    index = spark.table(name)
    assert index.columns == ["id", "text", "tag", "vector", "norm"]
    query = X.embed_text(spark, "yellow", model)
    assert S.search(index, query, "id", 1).first()["id"] == 3


def test_model_embedder(spark, texts):
    def load():
        def predict(batch):
            return np.array([[len(t), t.count("red")] for t in batch], dtype=np.float32)

        return predict

    embedder = X.ModelEmbedder(load, batch_size=2)
    index = X.build_index(texts, ["text"], embedder)
    assert {r.id: r.vector for r in index.collect()}[2] == [13.0, 2.0]
    assert X.embed_text(spark, "red", embedder) == [3.0, 1.0]
    assert S.search(index, [13.0, 2.0], "id", 1).first()["id"] == 2


def test_several_tables_and_answer(spark, texts):
    model = X.HashedTfIdf.fit(texts, ["text"])
    one = X.build_index(texts, ["text"], model)
    other = X.build_index(
        spark.createDataFrame([("x", "red green"), ("y", "blue")], "k string, text string"), ["text"], model
    )
    indexes = {"one": (one, "id"), "other": (other, "k")}
    query = X.embed_text(spark, "red green", model)
    found = S.search_tables(indexes, query, 2)
    assert Counter(r.table_name for r in found.collect()) == {"one": 2, "other": 2}
    assert [r.key for r in S.first_hits(found, 3).collect()] == ["2", "1", "x"]
    assert [r.key for r in S.first_hits(found, 1, rerank=True).collect()] == ["x"]

    answer = S.ask("red green", indexes, model)
    assert answer["answer"] == S.FOUND and len(answer["source_data"]) == 5
    assert answer["context"].startswith(
        'Based on the following data:\n\nRecord 1: {\n  "id": 2,\n  "text": "red red green",\n  "tag": "b"\n}\n\nRecord 2: {'
    )
    assert S.ask("red green", indexes, model, rerank=True)["source_data"][0]["data"] == '{"k":"x","text":"red green"}'
    spoken = S.ask("red", indexes, model, table="other", answer=lambda c, q: f"{q}: {c.count('Record')}")
    assert spoken["answer"] == "red: 2"

    def broken(context, question):
        raise RuntimeError("service down")

    assert S.ask("red", indexes, model, answer=broken)["answer"] == S.FOUND
    assert S.ask("red", {}, model) == {"answer": S.NO_DATA, "source_data": []}
    with pytest.raises(LookupError):
        S.ask("red", indexes, model, table="missing")


# ---- rows as text ------------------------------------------------------------------------------------


def test_combined_text_counts_null_as_text(texts):
    rows = texts.orderBy("id").select(R.combined_text(["text", "tag"]), R.combined_text(["tag", "id"], "None"))
    assert [tuple(r) for r in rows.collect()][2:4] == [("yellow | ", "None | 3"), (" | c", "c | 4")]
    with pytest.raises(ValueError):
        R.combined_text([])


def test_json_rows(spark):
    df = spark.sql("SELECT 'é \"q\"' AS a, CAST(NULL AS INT) AS b, TIMESTAMP '2024-01-02 03:04:05.678' AS t")
    js = df.select(R.row_json(["a", "b", "t"]).alias("js"))
    assert js.first()[0] == '{"a":"é \\"q\\"","b":null,"t":"2024-01-02T03:04:05.678"}'
    pretty = js.select(R.pretty_json("js")).first()[0]
    assert pretty == '{\n  "a": "\\u00e9 \\"q\\"",\n  "b": null,\n  "t": "2024-01-02T03:04:05.678"\n}'


def test_label(spark):
    assert spark.range(1).select(R.match_label(F.lit(0.8731))).first()[0] == "87.3% match"


def test_stored_indexes(spark, texts, name):
    texts.write.saveAsTable(name)
    assert X.store_index(spark, name, ["text"], "id", dim=1 << 12) == 5
    other = spark.newSession()
    index = X.indexed_tables(other)[name]
    assert (index.key, index.text_columns, index.target) == ("id", ["text"], f"{name}_index")
    model = X.HashedTfIdf.fit(texts, ["text"], 1 << 12)
    assert np.array_equal(index.model(other).idf, model.idf) and index.model(other).rows == 5
    word = next(w for r in texts.collect() for w in (r["text"] or "").split())
    query = X.embed_text(spark, word, model)
    want = hits(S.search(X.build_index(texts, ["text"], model), query, "id", 3), "id", "similarity")
    found = S.search_stored(other, word, [name], 3)
    assert [(int(r.key), r.similarity) for r in found.collect()] == [tuple(h) for h in want]
    assert S.ask_stored(other, word, name)["answer"] == S.FOUND
    with pytest.raises(LookupError):
        S.search_stored(other, word, [name + "x"])
    assert X.stored_index(spark, name) is None
