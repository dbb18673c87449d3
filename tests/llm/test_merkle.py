import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablework.llm import merkle, queries
from tests.llm.conftest import odd_rows

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row[c] for c in COLUMNS[:-1]] + [text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climbed(nodes):
    """The top of a tree and, for every leaf, the (siblings before, after) of each level."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        upper, wider = [], []
        for start in range(0, len(nodes), 8):
            run = nodes[start : start + 8]
            for k in range(len(run)):
                for i in groups[start + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            upper.append(h(*run))
            wider.append([i for g in groups[start : start + 8] for i in g])
        nodes, groups = upper, wider
    return nodes[0], paths


def brute(rows):
    """The rows of the query; rows are dictionaries."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        ranked = sorted(
            by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]))
        )
        trees[lang] = (ranked, *climbed([leaf_of(r, r["text"]) for r in ranked]))
    root, above = climbed([trees[lang][1] for lang in order])
    out = []
    for lang, upper in zip(order, above):
        ranked, subroot, paths = trees[lang]
        for row, path in zip(ranked, paths):
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                text = text.translate(LOWER)
            back = leaf_of(row, text)
            for left, right in path + upper:
                back = h(*left, back, *right)
            proof = h(*[x for left, right in path + upper for x in left + right])
            out.append((row["doc_id"], leaf_of(row, row["text"]), subroot, root, proof, back, back == root))
    return out


def judged(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verified(df, merkle.lowered_if(F.col("text"), tampered))


def test_whole_table(spark, folder):
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = queries.QUERIES["op11_manifest"](spark, folder).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows))
    assert {r["verified"] for r in found} == {True, False}


def test_sql_of_the_query(folder):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = db.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({queries.ORACLE['op11_manifest']})").fetchall()
    names = [c[0] for c in db.execute("SELECT * FROM documents").description]
    rows = [dict(zip(names, r)) for r in db.execute("SELECT * FROM documents").fetchall()]
    assert Counter(found) == Counter(brute(rows))


def test_odd_rows(spark, frame):
    df = frame(odd_rows()).unionByName(frame(odd_rows()[3:], "de")).unionByName(frame([(1, "A")], "")).unionByName(frame([(1, "A")], "é"))
    rows = [{c: r[c] for c in COLUMNS} for r in df.collect()]
    assert Counter(map(tuple, judged(df).collect())) == Counter(brute(rows))


def test_sizes_around_full_runs(spark):
    for size in (1, 8, 65):
        rows = [dict(zip(COLUMNS, (i, "s", "en", None, f"Text {i}"))) for i in range(size)]
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert Counter(map(tuple, judged(df).collect())) == Counter(brute(rows)), size


def test_many_languages_and_equal_rows(spark):
    rows = [dict(zip(COLUMNS, (i % 3, None, f"l{i % 90}", 5, "same"))) for i in range(400)]
    rows += [dict(zip(COLUMNS, (7, None, "hot", 5, "same"))) for _ in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, judged(df).collect())) == Counter(brute(rows))


def test_records_lead_from_the_root_to_every_leaf(spark, frame):
    rows = frame([(i, f"t{i % 40}") for i in range(100)], "en").unionByName(frame([(1, "x")], "de"))
    made = merkle.manifest(rows.select("lang", "doc_id", merkle.leaf(F.col("text")).alias("digest")), "lang", "doc_id")
    records = {r["digest"]: r["children"] for r in made.records().collect()}
    assert all(h(*children) == digest for digest, children in records.items())
    reached, todo = Counter(), [made.root().first()["root"]]
    while todo:
        digest = todo.pop()
        if digest in records:
            todo += records[digest]
        else:
            reached[digest] += 1
    assert reached == Counter(r["digest"] for r in made.leaves.collect())


def test_requests_of_some_leaves(spark, frame):
    made = merkle.manifest(
        frame([(i, f"t{i}") for i in range(70)], "en").select("lang", "doc_id", merkle.leaf(F.col("text")).alias("digest")),
        "lang",
        "doc_id",
    )
    found = merkle.proven(made, made.leaves.filter("doc_id in (3, 66)")).collect()
    assert sorted(r["doc_id"] for r in found) == [3, 66] and all(len(r["path"]) == 3 for r in found)


def test_empty_table(frame):
    assert judged(frame([])).collect() == []
