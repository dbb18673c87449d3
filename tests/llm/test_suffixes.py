import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tablework.llm import common, suffixes
from tests.llm.conftest import odd_rows


def brute(rows):
    texts = [((1 << 62 if i is None else i), (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(i, first.get(w, i))
    out = []
    for (name, _), (i, t) in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out.append((name, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(frame, rows):
    found = suffixes.without_repeats(frame(rows), keep_text=True).collect()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == brute(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(frame, seed, monkeypatch):
    draw = random.Random(seed)
    alphabet = draw.choice(["ab", "abcdé ", "the of and ".split()])

    def text(n):
        return "".join(draw.choice(alphabet) for _ in range(n))

    passages = [text(draw.choice([20, 49, 50, 51, 60, 84, 85, 200])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [text(draw.randint(0, 120)) for _ in range(3)]
        parts += draw.sample(passages, draw.randint(0, 3))
        draw.shuffle(parts)
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[draw.randrange(40)][1]) for i in range(10)]
    rows += [(200, "x" * 400), (201, "x" * 60), (202, "yx" * 40 + "z"), (203, "xy" * 60)]
    draw.shuffle(rows)
    # Small blocks and ranges, so that suffixes meet across their borders.
    monkeypatch.setattr(common, "SLICE_BYTES", 500)
    monkeypatch.setattr(suffixes, "RANGE_SUFFIXES", 100)
    check(frame, rows)


def test_odd_rows(frame):
    check(frame, odd_rows() + [(9, odd_rows()[8][1][1000:4000] + "end")])


def test_whole_table(spark, folder, frame):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(frame, [tuple(r) for r in docs])


def peak(run):
    """MB that numpy holds at most while it runs."""
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def block(size, rows):
    body = np.random.default_rng(1).integers(97, 123, size).astype(np.uint8)
    return body, np.linspace(0, size, rows + 1).astype(np.int64)


def test_pieces_change_nothing(monkeypatch):
    body, offsets = block(30_000, 37)
    body[7000:9000] = body[20_000:22_000] = 97
    whole = suffixes.Suffixes(body, offsets)
    for piece in (1, 13, 1000):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        cut = suffixes.Suffixes(body, offsets)
        for name in ("places", "most", "least", "rows", "leading"):
            assert np.array_equal(getattr(whole, name), getattr(cut, name))


def test_memory_of_a_block():
    """Many texts or a single one: what a block takes beyond its running sum."""
    for rows in (1, 300):
        body, offsets = block(common.SLICE_BYTES, rows)
        assert peak(lambda: suffixes.Suffixes(body, offsets)) < 45


class Held:
    value = np.zeros(0, np.uint64)


def test_a_block_leaves_nothing_to_the_next():
    """Blocks one after the other take no more than one alone."""
    body, offsets = block(common.SLICE_BYTES, 300)
    leading = suffixes.Leading(suffixes.Suffixes(body, offsets), np.arange(300))
    marks = np.packbits(np.ones(len(leading.values), bool)).tobytes()
    shared = len(suffixes.Suffixes(body, offsets).places)
    row = {"block": 1, "ids": list(range(300)), "sizes": np.diff(offsets).tolist(), "body": body.tobytes()}
    asked = {**row, "several": [{"range": 0, "mask": marks}]}
    cut = {**asked, "smaller": [{"range": 0, "mask": suffixes._packed(np.zeros(shared, np.uint64))}]}
    steps = [(suffixes._ask_leading(Held), row), (suffixes._ask_strings(Held), asked), (suffixes._cut_texts(Held, False), cut)]
    for step, row in steps:
        batch = pa.RecordBatch.from_pylist([row])
        for _ in step(iter([batch])):
            pass
        one, more = (peak(lambda: [len(b) for b in step(iter([batch] * n))]) for n in (1, 3))
        assert more < 1.1 * one, (one, more)


def test_empty_table(frame):
    assert suffixes.without_repeats(frame([])).collect() == []
