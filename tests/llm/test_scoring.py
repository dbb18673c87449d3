import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from tablework.llm import mixing, scoring
from tests.llm.conftest import odd_rows


def brute(rows):
    def tokens(t):
        return (t or "").encode().lower().split() + [b""]

    away = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for held, (_, t) in zip(away, rows) if not held for w in tokens(t))
    total, different = sum(counts.values()), len(counts)
    out = []
    for held, (i, t) in zip(away, rows):
        base = sum(log10((counts[w] + 0.1) / (total + 0.1 * (different + 1))) for w in tokens(t))
        out.append((i, held, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, len((t or "").encode()), base))
    return sorted(out, key=lambda r: str(r[:6]))


def check(found, rows):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "n_bytes", "base_score"]
    got = sorted((tuple(r[n] for n in names) for r in found), key=lambda r: str(r[:6]))
    want = brute(rows)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-9)
    for r in found:
        assert r["score"] < 0
        assert r["bits_per_byte"] == (pytest.approx(-r["score"] / log10(2) / r["n_bytes"]) if r["n_bytes"] else None)


@pytest.mark.parametrize("common", [0, 40, 65_536])
def test_whole_table_and_held_out_gain(spark, folder, common, monkeypatch):
    monkeypatch.setattr(scoring, "COMMON", common)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = scoring.scores(docs).collect()
    check(found, [(r["doc_id"], r["text"]) for r in docs.collect()])
    # New texts are far likelier than under the frequencies of single bytes, and known words nearly as likely as under
    # the word counts, though the model also has to leave room for every unknown word.
    texts = {r["doc_id"]: _coded(r["text"]) for r in docs.collect()}
    held = [r for r in found if r["held_out"]]
    names = {r["doc_id"] for r in held}
    learned = Counter(c for i, t in texts.items() if i not in names for c in t)
    total = sum(learned.values())
    single = sum(log10((learned[c] + 1) / (total + 256)) for r in held for c in texts[r["doc_id"]])
    assert sum(r["score"] for r in held) > 0.75 * single
    assert sum(r["score"] for r in held) > 1.2 * sum(r["base_score"] for r in held)


def _coded(text):
    return b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n"


def test_odd_rows(frame):
    check(scoring.scores(frame(odd_rows())).collect(), odd_rows())
    assert scoring.scores(frame([])).collect() == []


def test_nothing_to_learn_from(frame):
    name = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = scoring.scores(frame([(name, "a b")])).first()
    assert row["held_out"] and row["n_known"] == 0 and row["train_tokens"] == 0 and row["base_score"] == 0


def test_probabilities_of_all_words_sum_to_one():
    """The next byte's probabilities, from the bits' ones, leave nothing over."""
    draw = np.random.default_rng(0)
    known = [b"the", b"then", b"than", b"a"]
    table = np.zeros(2 * mixing.SLOTS)
    block = mixing.block(known)
    mixing.add_counts(table, block, mixing.step_weights(block, np.array([9.0, 3.0, 2.0, 5.0])))
    table = table.astype(np.float32)
    weights = mixing.first_weights() + draw.normal(0, 0.05, (mixing.GATES, mixing.INPUTS))
    refined = mixing.refinement(draw.integers(0, 9, (mixing.GATES * mixing.BUCKETS, 2)))
    nexts = [b"th" + bytes([c]) for c in range(256) if c not in b" \t\n\v\f\r"]
    block = mixing.block(nexts + [b"th"])
    steps = mixing.word_scores(table, weights, refined, block)
    # Take the closing byte of each word off again.
    closed = mixing.block([w + b"" for w in nexts])
    assert len(closed.starts) == len(nexts)
    prefix = {}
    for w, s in zip(nexts + [b"th"], steps):
        prefix[w] = s
    one = _byte_probabilities(table, weights, refined, b"th")
    assert abs(one.sum() - 1) < 1e-9
    assert one[ord("e")] > one[ord("q")] and prefix[b"the"] > prefix[b"thq"]


def _byte_probabilities(table, weights, refined, before: bytes) -> np.ndarray:
    out = np.zeros(256)
    for c in range(256):
        b = mixing.block([before + bytes([c])])
        x, gate, bits = mixing._inputs(table, b, slice(None), None)
        mixed = (weights[gate].T * x).sum(0)
        one = (mixing._squash(np.clip(mixed, -16, 16)) + refined[mixing._bucket(mixed, gate)]) / 2
        one = np.clip(one, 1e-7, 1 - 1e-7)
        each = np.where(bits == 1, one, 1 - one).reshape(-1, 8).prod(1)
        out[c] = each[b.step_of[len(before)]]
    return out


def test_learning_helps():
    words = [f"w{i % 7}x{i % 5}".encode() for i in range(35)]
    counts = np.arange(1.0, 36)
    block = mixing.block(words)
    table = np.zeros(2 * mixing.SLOTS)
    mixing.add_counts(table, block, mixing.step_weights(block, counts))
    table = table.astype(np.float32)
    weights, outcomes = mixing.first_weights(), np.zeros((mixing.GATES * mixing.BUCKETS, 2))
    before = mixing.word_scores(table, weights, mixing.refinement(outcomes), block) @ counts
    squares, seen = np.full(weights.shape, 1e-3), np.zeros(mixing.GATES)
    for _ in range(20):
        mixing.learn(table, weights, squares, outcomes, seen, block, mixing.step_weights(block, counts))
    assert mixing.word_scores(table, weights, mixing.refinement(outcomes), block) @ counts > before
