import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablework.llm import packing
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    """Rooms left after best-fit decreasing, one piece and one scan of all bins at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= length]
        if fitting:
            best = min(fitting, key=lambda i: rooms[i])
            rooms[best] -= length
        else:
            rooms.append(capacity - length)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_rules_are_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 50, 64, 2048])
    lengths = [draw.randint(1, draw.choice([3, capacity])) for _ in range(400)]
    rules = packing.packing_rules(Counter(lengths), capacity)
    used = defaultdict(list)
    for i, (length, rank, first, each, offset) in enumerate(rules.tolist()):
        after = rules[i + 1] if i + 1 < len(rules) and rules[i + 1][0] == length else None
        for r in range(rank, int(after[1]) if after is not None else Counter(lengths)[length]):
            used[first + (r - rank) // each].append((offset + (r - rank) % each * length, length))
    for pieces in used.values():
        ends = [a + n for a, n in sorted(pieces)]
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= capacity
    rooms = Counter(capacity - sum(n for _, n in pieces) for pieces in used.values())
    assert rooms == plain_best_fit(lengths, capacity)


def check(found, rows):
    model = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [0, *(a + n for a, n in pieces)][: len(pieces)]
        assert sum(n for _, n in pieces) <= 2048
    assert Counter(2048 - sum(n for _, n in p) for p in bins.values()) == plain_best_fit([w[3] for w in want], 2048)


def test_odd_rows(frame):
    rows = odd_rows() + [(8, "it's <|endoftext|> I'LL go\x1cnow   x"), (9, "ΣΣ é ́x")]
    check(packing.packed(frame(rows), PATH).collect(), rows)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check(packing.packed(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_ids_can_be_kept(frame):
    rows = [(1, "some words"), (2, None)]
    for r in packing.packed(frame(rows), PATH, keep_ids=True).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_empty_table(frame):
    assert packing.packed(frame([]), PATH).collect() == []
