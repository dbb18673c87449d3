import random
import tracemalloc

import numpy as np

from tablework.llm import common, graph, minhash, shingling
from tablework.session import stage
from tests.llm.conftest import odd_rows
from tests.llm.test_ngramjoin import grams


def brute(rows, width, percent=80):
    """Component of each row by comparing all pairs; the numbers of the rows stand for them."""
    sets = [grams(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * len(sets[i] | sets[j]):
                    label[max(root(i), root(j))] = min(root(i), root(j))
    return sets, [root(i) for i in range(len(rows))]


def check(frame, rows, width):
    found = minhash.near_copies(frame(rows), width).collect()
    sets, roots = brute(rows, width)
    want = []
    for i, (name, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i]]
        named = [x for x in group if x is not None]
        want.append((name, len(sets[i]), min(named) if named else None))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == sorted(want, key=str)
    assert sum(r["best"] for r in found) == len(set(roots))
    assert all(r["doc_id"] == r["component_id"] for r in found if r["best"])
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)


def test_memory_of_a_slice():
    """The shingles of a slice of many texts are hashed piece by piece, and are those of each text alone."""
    draw = np.random.default_rng(2)
    data = np.where(draw.random(common.SLICE_BYTES) < 0.15, 32, draw.integers(97, 123, common.SLICE_BYTES)).astype(np.uint8)
    offsets = np.linspace(0, len(data), 301).astype(np.int64)
    offsets[5] = offsets[6]
    shingling.shingle_hashes(data, offsets, 5)
    tracemalloc.start()
    hashes, rows = shingling.shingle_hashes(data, offsets, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 15e6
    for row in (0, 4, 5, 6, 299):
        alone, _ = shingling.shingle_hashes(data[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]), 5)
        assert np.array_equal(hashes[rows == row], alone)


def test_odd_rows(frame):
    for width in (4, 5):
        check(frame, odd_rows(), width)


def test_chains_hubs_and_copies(frame):
    draw = random.Random(4)
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(draw.choice([5, 12, 60, 150]))]
        for step in range(25):
            rows.append((len(rows), " ".join(words)))
            if g % 2:  # a chain: each differs a little from the one before
                words[draw.randrange(len(words))] += "x"
            else:  # a hub: all differ from one
                own = list(words)
                own[draw.randrange(len(own))] += str(step)
                rows.append((len(rows), " ".join(own)))
    draw.shuffle(rows)
    check(frame, rows, 4)


def test_whole_table(spark, folder, frame):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(frame, [tuple(r) for r in docs], 4)


def test_signature_has_smallest_and_largest():
    hashes = np.arange(1, 9, dtype=np.uint64)
    one = minhash.band_keys(hashes, np.array([0]))
    two = minhash.band_keys(np.concatenate([hashes[::-1], hashes + np.uint64(9)]), np.array([0, 8]))
    assert (one[0] == two[0]).all() and (one[0] != two[1]).any()


def test_many_like_a_template(frame):
    """Texts of one bucket that are like each other about as often as not."""
    draw = random.Random(11)
    words = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(words)
        for _ in range(draw.randrange(2, 9)):
            own[draw.randrange(len(own))] = f"own{i}x{draw.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    check(frame, rows, 4)


def test_representatives_keep_their_columns(frame):
    kept = minhash.representatives(frame(odd_rows()))
    assert kept.columns == frame([]).columns
    assert kept.count() == len(set(brute(odd_rows(), 5)[1]))


def test_components_of_a_long_chain(spark, monkeypatch):
    edges = stage(spark.range(300).selectExpr("id * 7 % 301 as a", "(id + 1) * 7 % 301 as b"), "edges")
    more = stage(edges.selectExpr("a + 1000 as a", "b + 1000 as b").unionByName(edges.filter("a != 7")), "edges")
    small = [graph.components(e).orderBy("node").collect() for e in (edges, more, edges.limit(0))]
    assert {r["label"] for r in small[0]} == {0} and {r["label"] for r in small[1]} >= {0, 1000}
    # Edges that could not be broadcast.
    monkeypatch.setattr(graph.C, "fits", lambda side, most=0: False)
    assert [graph.components(e).orderBy("node").collect() for e in (edges, more)] == small[:2]


def test_empty_table(frame):
    assert minhash.near_copies(frame([])).collect() == []
    assert minhash.representatives(frame([])).collect() == []


def test_bands_are_not_shuffled_for_the_heads(spark, frame, monkeypatch):
    """There can be more first rows than a broadcast takes, while few classes have several rows."""
    plans = {}

    def staged(df, label="stage", **options):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label, **options)

    monkeypatch.setattr(minhash, "stage", staged)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    rows = [(i, " ".join(f"w{i % 40}x{j}" for j in range(9))) for i in range(43)]
    # Only what is marked for it is broadcast.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(frame, rows, 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans["bands"] and "SortMergeJoin" not in plans["bands"]
