"""Documents are coded in order: what stands before a word, and the document so far, change its probability."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablework.llm import border, scoring


def test_order_of_words_counts(frame):
    text = "the cat sat on the mat"
    away = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, text) for i in range(40)] + [(away[0], text), (away[1], "mat the on sat cat the")]
    scores = {r["doc_id"]: r["score"] for r in scoring.scores(frame(rows)).collect()}
    assert scores[away[0]] > scores[away[1]] + 0.5


def test_a_document_learns_from_itself(frame):
    """The second half of a text of few words is likelier than the first, though the corpus has none of them."""
    away = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    half = "zyx wvu zyx tsr wvu " * 20
    rows = [(1, "other words of a text " * 9), (away[0], half), (away[1], half * 2)]
    scores = {r["doc_id"]: r["score"] for r in scoring.scores(frame(rows)).collect()}
    assert scores[away[1]] > 1.6 * scores[away[0]]


def test_followed_by_brute_force():
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["a", "Bc", "def", "ghij"]) for _ in range(draw.randrange(6))) for _ in range(50)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    taken = np.array([i % 3 > 0 for i in range(50)])
    want = []
    for text, some in zip(texts, taken):
        words = [b"", *text.lower().encode().split(), b""]
        for a, b in zip(words, words[1:]) if some else ():
            end = (b"\n " + a)[-3:] if a else b"\n\n\n"
            want.append(int.from_bytes(end[::-1], "big") << 8 | (b[0] if b else 10))
    assert sorted(scoring._followed(data, offsets, taken).tolist()) == sorted(want)


@pytest.mark.parametrize("counts", [np.zeros(256), np.arange(256) % 7, np.eye(256)[65] * 1e6])
def test_code_parts_all_bytes(counts):
    """Every byte's code is its own, and the probabilities of all of them leave nothing over."""
    code = border.Code(counts)
    of, place, node, bit = code.bits(np.arange(256))
    one = np.random.default_rng(1).uniform(0.1, 0.9, 255)
    each = np.where(bit == 1, one[node], 1 - one[node])
    assert np.multiply.reduceat(each, np.flatnonzero(place == 0)).sum() == pytest.approx(1)
    held = np.flatnonzero(counts)
    sums = code.below(held * 0, held, counts[held], 1)[0]
    for n in range(0, 255, 17):
        right = of[(node == n) & (bit == 1)]
        assert sums[code.high[n]] - sums[code.middle[n]] == counts[right].sum()


class Held:
    def __init__(self, value):
        self.value = value


def model_of(text, seen=()):
    """What ``scoring`` gives to every task: all words as common ones, and what followed each ending."""
    words = sorted({*text.lower().encode().split(), *seen, b""})
    columns = [pa.array(words, pa.binary()), pa.array([1] * len(words)), pa.array([-1.0] * len(words), pa.float32())]
    common = pa.table(columns, ["word", "learned", "rest"])
    data = np.frombuffer(text.encode(), np.uint8)
    keys, counts = np.unique(scoring._followed(data, np.array([0, len(data)]), np.array([True])), return_counts=True)
    first = border.first_weights(), border.refinement(np.zeros((border.REFINED, 2)))
    return Held(common), Held(((keys >> 8, keys & 255, counts), *first, 100.0))


def documents(texts):
    none = pa.array([[]] * len(texts), pa.list_(pa.struct([("place", pa.int32()), ("learned", pa.int64()), ("rest", pa.float32())])))
    columns = [pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts), none]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "text", "rest"])


def coded(texts, model):
    return np.concatenate([b.column(6).to_numpy() for b in scoring._documents(*model)(iter([documents(texts)]))])


def test_an_ending_is_looked_up_once_by_a_task(monkeypatch):
    text = " ".join(f"{a}{b} the of" for a in "abcdefgh" for b in "mnopqr")
    asked, plain = [], border.Border.logits

    def logits(self, used, *rest):
        asked.extend(used.tolist())
        return plain(self, used, *rest)

    monkeypatch.setattr(border.Border, "logits", logits)
    monkeypatch.setattr(scoring, "SIDE_BYTES", 1 << 9)
    coded([text] * 6, model_of(text))
    assert asked and len(asked) == len(set(asked))


def test_endings_that_cannot_all_be_held_give_the_same_scores(monkeypatch):
    draw = np.random.default_rng(5)
    texts = [" ".join("".join(draw.choice([*"abcde"], 3)) for _ in range(80)) for _ in range(12)]
    model = model_of(" ".join(texts))
    monkeypatch.setattr(scoring, "SIDE_BYTES", 1 << 9)
    whole = coded(texts, model)
    monkeypatch.setattr(border, "HELD_BYTES", 1 << 10)
    assert np.array_equal(coded(texts, model), whole)


def test_how_often_words_stood_before():
    draw = np.random.default_rng(6)
    sizes = np.array([1, 40, 3, 200])
    for most in (5, 1 << 17):
        words = draw.integers(0, most, sizes.sum())
        words[:50] %= 7
        plain, start = [], 0
        for size in sizes:
            doc = words[start : start + size].tolist()
            plain += [doc[:i].count(w) for i, w in enumerate(doc)]
            start += size
        assert border.earlier(sizes, words).tolist() == plain
