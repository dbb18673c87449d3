import random
import re

import pytest

from tablework.llm import licenses
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base, labels, shares = [], set(), [0.0]
    for t in licenses.PHRASES:
        key = t.words
        for p in range(len(words) - len(key) + 1):
            if words[p : p + len(key)] == key:
                base.append((p, t.label))
                shares.append(1.0)
    for t in licenses.TEMPLATES:
        for p in range(-len(t.words), len(words)):
            inside = all(p + i >= 0 and words[p + i : p + i + len(k)] == k for i, k in t.key_places())
            if inside:
                same = sum(0 <= p + i < len(words) and words[p + i] == w for i, w in enumerate(t.words))
                labels.add(t.label)
                shares.append(same / len(t.words))
    places = [p for p, _ in base]
    names = {label for _, label in base}
    return len(words), len(base), min(places, default=None), max(places, default=None), sorted(names), sorted(names | labels), round(max(shares), 9)


def check(frame, rows):
    found = licenses.scanned(frame(rows)).collect()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    got = [(r["doc_id"], *(r[n] for n in names), round(r["score"], 9)) for r in found]
    assert sorted(got, key=str) == sorted([(i, *brute(t)) for i, t in rows], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(frame, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(120):
        parts = []
        for _ in range(draw.randint(0, 6)):
            t = draw.choice(licenses.PHRASES + licenses.TEMPLATES)
            words = list(t.words)
            if draw.random() < 0.4:
                words[draw.randrange(len(words))] = draw.choice(["mit", "x", "the"])
            if draw.random() < 0.3:
                words = words[draw.randint(0, 3) : len(words) - draw.randint(0, 3)]
            parts.append(draw.choice([" ", "-", "\n"]).join(w.upper() if draw.random() < 0.2 else w for w in words))
            parts.append(" ".join(draw.choice(["under", "the", "by", "nc", "cc", "other", "é"]) for _ in range(draw.randint(0, 5))))
        rows.append((i, " ".join(parts)))
    check(frame, rows)


def test_whole_table(spark, folder, frame):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(frame, [tuple(r) for r in docs])


def test_odd_rows(frame):
    check(frame, odd_rows() + [(9, "cc by nc by nc cc by nc"), (10, "licence by cc"), (11, "permission " * 50)])
    assert licenses.scanned(frame([])).collect() == []


def test_words_of_equal_hash_are_told_apart(frame, monkeypatch):
    real = licenses.C.Spans.hashes
    monkeypatch.setattr(licenses.C.Spans, "hashes", lambda self, a, b: real(self, a, b) * 0 + (b - a).astype("uint64"))
    vocabulary = licenses.Vocabulary(["by"])
    import numpy as np

    data = np.frombuffer(b"xx by", np.uint8)
    numbers, _, spelled = vocabulary.read(data, np.array([0, 5]))
    assert numbers.tolist() == [0, 0]
    assert not vocabulary.same(spelled, 0, [0]) and vocabulary.same(spelled, 1, [0])


def test_a_key_phrase_must_be_in_its_template():
    with pytest.raises(ValueError):
        licenses.Template("x", "some words", ("other",)).key_places()
