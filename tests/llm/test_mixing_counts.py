"""What the model knows of each context is that context's own, however many there are."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tablework.llm import common, mixing, scoring


def brute(words, counts):
    """How often a 0 and a 1 followed each context and the bits of the byte so far."""
    held = defaultdict(lambda: [0, 0])
    for steps, n in zip(map(_steps, words), counts):
        for at in steps:
            held[at[:-1]][at[-1]] += n
    return held


def _steps(word):
    text = b"    " + (word + b" " if word else b"\n")
    for i in range(4, len(text)):
        contexts = [i == 4, text[i - 1 : i], text[i - 2 : i], text[i - 3 : i], text[i - 4 : i], text[4:i]]
        bits = f"{text[i]:08b}"
        for k, context in enumerate(contexts):
            for j in range(8):
                yield k, context, bits[:j], int(bits[j])


def test_every_context_has_its_own_counts(monkeypatch):
    """With far more different contexts than a bounded table has slots, in blocks that cut words with one beginning."""
    draw = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    words = {letters[draw.integers(0, 26, n)].tobytes() for n in draw.integers(3, 16, 20_000)}
    words |= {b"", b"same", b"sameness", b"\xff\xfe", *(b"same" + w for w in list(words)[:2000])}
    words = sorted(words)
    counts = draw.integers(0, 5, len(words))
    held = brute(words, counts)
    assert sum(k == 5 for k, *_ in held) > 1 << mixing.SIZES[5]

    parts = np.array_split(np.arange(len(words)), 7)
    tables = [
        pa.table([[n] * len(p), [words[i] for i in p], counts[p]], ["block", "word", "learned"])
        for n, p in enumerate(parts)
    ]
    sums = Counter()
    needs = []
    for table in tables:
        found = scoring._steps(table).to_pylist()
        needs.append({r["context"] for r in found})
        for r in found:
            for e in r["held"]:
                sums[r["context"], e["byte"]] += e["n"]
    for part, table, need in zip(parts, tables, needs):
        rows = [(c, b, n) for (c, b), n in sums.items() if c in need]
        rows = pa.table([pa.array(x, pa.int64()) for x in zip(*rows)], ["context", "byte", "n"])
        _, block, _, _, own = scoring._with_table(table, rows)
        own = own.reshape(-1, 2)
        for n in range(0, len(part), 97):
            at = block.step_of[block.starts[n] :]
            for i, (k, context, before, _) in enumerate(_steps(words[part[n]])):
                step, place = divmod(i, 6 * 8)
                found = own[block.slots[at[step], place // 8, place % 8]]
                assert found.tolist() == held[k, context, before]


@pytest.mark.parametrize("size", [1, 200])
def test_blocks_change_no_scores(spark, frame, monkeypatch, size):
    """Where blocks are cut only changes how weights are learned; with weights that stay, the scores are equal."""
    monkeypatch.setattr(mixing, "RATE", 0.0)
    rows = [(i, f"same words word{i % 13} sameness{i} wo w") for i in range(60)]
    whole = {r["doc_id"]: r["score"] for r in scoring.scores(frame(rows)).collect()}
    monkeypatch.setattr(scoring, "BLOCK_BYTES", size)
    cut = {r["doc_id"]: r["score"] for r in scoring.scores(frame(rows)).collect()}
    assert cut == pytest.approx(whole, rel=1e-6)


def test_distinct_values_are_in_order(monkeypatch):
    """Values of which few differ are not sorted as a whole."""
    draw = np.random.default_rng(3)
    plain, sorted_rows = np.argsort, []
    for values in (draw.integers(0, 99, 5000), draw.integers(0, 9, 700).astype(np.uint64) << np.uint64(61), np.zeros(0, np.int64)):
        want, which = np.unique(values, return_inverse=True)
        monkeypatch.setattr(np, "argsort", lambda a, **k: sorted_rows.append(len(a)) or plain(a, **k))
        found, at = common.distinct(values)
        monkeypatch.undo()
        assert found.tolist() == want.tolist() and at.tolist() == which.tolist()
        assert sorted_rows.pop() == len(want)
