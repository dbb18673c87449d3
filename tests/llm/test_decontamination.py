import random
import re

import pytest

from tablework.llm import decontamination
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                owners = windows.get(tuple(w[p : p + size]))
                if owners:
                    hit |= set(range(p, p + size))
                    found |= {x for x in owners if x is not None}
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id int, text string")


def check(spark, frame, docs, items):
    found = decontamination.contamination(frame(docs), items_frame(spark, items)).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in found]
    assert sorted(got, key=str) == brute(docs, items)
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, frame, seed):
    draw = random.Random(seed)
    vocabulary = ["The", "of", "a-b", "été", "x1", "UPPER"]

    def text(n):
        return draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))

    items = [(i, text(draw.choice([0, 1, 4, 9, 10, 11, 30]))) for i in range(12)] + [(None, text(12)), (3, None), (3, text(14))]
    docs = [(i, text(draw.randint(0, 80))) for i in range(40)]
    for i in range(20):
        item = words(draw.choice(items)[1])
        cut = draw.randint(0, len(item))
        docs.append((100 + i, " ".join([text(5), *item[cut : cut + draw.randint(0, 14)], text(3)])))
    check(spark, frame, docs, [x for x in items if len(words(x[1])) != 1])
    check(spark, frame, docs, items)


def test_odd_rows(spark, frame):
    docs = odd_rows()
    items = [(1, "same TEXT here now again"), (2, " ".join(docs[8][1].split()[5:40])), (3, ""), (4, None)]
    check(spark, frame, docs, items)
    check(spark, frame, docs, [])
    check(spark, frame, [], items)


def test_rows_that_stay_are_as_they_were(spark, frame):
    docs = odd_rows()
    kept = decontamination.decontaminated(frame(docs), items_frame(spark, [(1, "same text here now again")]))
    assert kept.columns == frame(docs).columns
    assert sorted(map(str, [tuple(r)[:2] for r in kept.collect()])) == sorted(
        str(d) for d in docs if words(d[1]) != "same text here now again".split()
    )
