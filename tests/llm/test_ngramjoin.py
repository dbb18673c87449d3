import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablework.llm import common, ngramjoin, queries
from tests.llm.conftest import odd_rows

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width):
    words = (text or "").translate(LOWER)
    for c in SPACE:
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if 0 < len(words) < width:
        return {" ".join(words)}
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width=4, percent=85):
    sets = [grams(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((name, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def check(df, rows, **how):
    found = ngramjoin.linked(df, **how).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute(rows, **how)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = queries.QUERIES["op13_ngram_join"](spark, folder)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == brute([tuple(r) for r in docs])


def test_odd_rows(frame):
    check(frame(odd_rows()), odd_rows())


def test_borders_of_the_similarity(frame):
    """Pairs exactly at the bound, and one n-gram to either side, for sets of equal and of different sizes."""
    rows = []
    for base, (size, more, own) in enumerate([(37, 0, 3), (37, 0, 4), (17, 3, 0), (17, 4, 0), (100, 10, 4), (100, 10, 5), (6, 1, 0), (6, 2, 0)]):
        words = [f"b{base}w{i}" for i in range(size)]
        rows.append((len(rows), " ".join(words + [f"b{base}x{i}" for i in range(own)])))
        rows.append((len(rows), " ".join([f"b{base}y{i}" for i in range(own + more)] + words)))
    assert {Fraction(len(grams(a, 1) & grams(b, 1)), len(grams(a, 1) | grams(b, 1))) >= Fraction(85, 100) for (_, a), (_, b) in zip(rows[::2], rows[1::2])} == {True, False}
    check(frame(rows), rows, width=1)


def test_groups_about_one_text(frame):
    """Many texts near the bound of each other, on n-grams that a third of all rows have, in any number of components."""
    draw = random.Random(6)
    rows = []
    for g in range(4):
        words = [f"g{g % 2}w{i}" for i in range(draw.choice([40, 150]))] + [f"g{g}t{i}" for i in range(20)]
        for _ in range(60):
            own = list(words)
            for _ in range(draw.randrange(1, 9)):
                own[draw.randrange(len(own))] = f"n{draw.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, f"shared line of many documents in this table and {i} more {i * 7}") for i in range(60)]
    draw.shuffle(rows)
    check(frame(rows), rows)


def test_chains_and_copies(frame):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for step in range(50):
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, "  ".join(words).upper())]
        words[draw.randrange(80)] += "x"
    check(frame(rows), rows)


def test_filters_never_lose_a_pair(frame):
    """Every similar pair of random sets passes all filters at its first common n-gram."""
    draw = random.Random(9)
    rows = []
    for i in range(120):
        words = [f"v{draw.randrange(60)}" for _ in range(30)] if i % 2 == 0 else rows[-1][1].split()
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = f"v{draw.randrange(60)}"
        rows.append((i, " ".join(dict.fromkeys(words))))
    df = common.identified(common.texts(frame(rows)), "row", "documents")
    number = {r["doc_id"]: r["row"] for r in df.collect()}
    found = ngramjoin.entries(df.select("row", "text"), 1, 80, 3600).withColumn("label", F.col("row"))
    met = found.join(ngramjoin._as_other(found), "gram").filter("row < row_x").filter(ngramjoin._met(80))
    met = {(r["row"], r["row_x"]) for r in met.select("row", "row_x").distinct().collect()}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            one, two = grams(x, 1), grams(y, 1)
            if 100 * len(one & two) >= 80 * len(one | two):
                assert tuple(sorted((number[a], number[b]))) in met


def test_near_copies_that_do_not_link_seldom_meet(frame):
    """Texts that each leave out other words of one text have the same numbers of n-grams of every frequency."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        gone = set(draw.sample(range(200), 5))
        rows.append((i, " ".join(w for j, w in enumerate(words) if j not in gone)))
    sets = [grams(t, 4) for _, t in rows]
    links = sum(100 * len(x & y) >= 85 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    df = common.identified(common.texts(frame(rows)), "row", "documents")
    found = ngramjoin.entries(df.select("row", "text"), 4, 85, sum(map(len, sets)))
    met = found.join(ngramjoin._as_other(found), "gram").filter("row < row_x").filter(ngramjoin._met(85))
    assert links <= met.select("row", "row_x").distinct().count() <= 3 * links + 100
    check(frame(rows), rows)


def test_rows_are_numbered_alike(spark, folder, frame):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one, two = (common.identified(docs.select(*c), "row", "documents") for c in (["doc_id"], ["doc_id", "text"]))
    assert one.count() == docs.count() == one.join(two, ["row", "doc_id"]).select("row").distinct().count()
    several = docs.selectExpr("doc_id", "explode(array(1, 2)) as twice")
    assert common.identified(several, "row", "documents").select("row").distinct().count() == 2 * docs.count()


def test_empty_table(frame):
    assert ngramjoin.linked(frame([])).collect() == []


@pytest.mark.parametrize("n", range(1, 60))
def test_prefix_length(n):
    """A similar set has at least ``n - prefix + 1`` n-grams in common with one of ``n``."""
    import numpy as np

    assert n - int(ngramjoin.prefix(np.array([n]), 85)[0]) + 1 == -(-85 * n // 100)
