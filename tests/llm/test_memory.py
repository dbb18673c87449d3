"""What a worker still holds of one operator when it is used by the next one."""

import gc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tablework.llm import common, decontamination, language, minhash, packing


class Held:
    def __init__(self, value):
        self.value = value


def texts(size=1):
    words = " ".join(f"word{i} zählt" for i in range(size))
    columns = [pa.array([1], pa.int64()), pa.array([1], pa.int64()), pa.array([words])]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text"])


def judge():
    return language._predictor(Held(language.Network(["de", "en"])))(iter([texts()]))


def pack():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        held = Held(file.read())
    return packing._pieces(held, 2048, b"\0\0\0\0", False)(iter([texts()]))


def decontaminate():
    bits = np.zeros(1 << (decontamination.MAP_BITS - 6), np.uint64)
    return decontamination._document_rows(Held(bits), [])(iter([texts()]))


def compare():
    return minhash._signatures(5)(iter([texts()]))


def kept():
    gc.collect()
    return sorted(type(x).__name__ for x in gc.get_objects() if isinstance(x, (language.Reader, packing.Encoder)))


@pytest.mark.parametrize(
    "first, then, left",
    [(judge, compare, []), (judge, pack, ["Encoder"]), (pack, decontaminate, []), (judge, judge, ["Reader"])],
)
def test_a_worker_remembers_for_one_operator(first, then, left):
    list(first())
    assert len(kept()) == 1
    list(then())
    assert kept() == left


def test_what_is_remembered_stays_for_the_next_task():
    made = []
    for _ in range(2):
        assert common.remembered("a", lambda: made.append(1) or "value") == "value"
        assert [len(offsets) for _, _, offsets in common.slices(iter([texts()]), keep=True)] == [2]
    assert made == [1]
