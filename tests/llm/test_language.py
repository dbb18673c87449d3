import numpy as np

from tablework.llm import language
from tablework.llm.queries import QUERIES
from tests.llm.conftest import odd_rows


def test_gradients_by_differences():
    draw = np.random.default_rng(3)
    model = language.Network(["a", "b", "c"], units=4)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    words, labels = draw.integers(97, 101, (6, 5)), draw.integers(0, 3, 6)
    _, grads = model.gradients(words, labels)
    for name, grad in grads.items():
        for place in zip(*(draw.integers(0, n, 4) for n in grad.shape)):
            place = (98, *place[1:]) if name.startswith("in") else place
            kept, step = model.weights[name][place], 1e-2
            model.weights[name][place] = kept + step
            high, _ = model.gradients(words, labels)
            model.weights[name][place] = kept - step
            low, _ = model.gradients(words, labels)
            model.weights[name][place] = kept
            assert abs((high - low) / (2 * step) - grad[place]) < 1e-4, name


def test_held_out_accuracy(spark, folder):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op10_language"](spark, folder).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r["held_out"]]
    right = [r for r in held if r["lang_pred"] == truth[r["doc_id"]]]
    assert len(held) > 200 and len(right) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_words_remembered_give_what_the_bytes_give():
    samples = [("en", [b"the", b"and", b"with"]), ("de", [b"der", b"und", b"mit"])]
    model = language.trained(samples, steps=60)
    sums = model.label_words([b"the", b"x" * 70, b"12"])
    one = model.probabilities(np.frombuffer(b" the", np.uint8)[None])[0]
    assert np.allclose(sums[0, :-1], one[1:].sum(0), atol=1e-5) and sums[0, -1] == 3
    assert sums[1, -1] == 70 and sums[2, -1] == 2
    reader = language.Reader(model)
    assert np.allclose(reader.totals([b"The 12 x-the", b""])[0], sums[0] * 2 + model.label_words([b"x"])[0], atol=1e-4)
    labels = language.byte_labels(model, "the  und")
    assert labels[3] is None and labels[:3] == ["en"] * 3 and labels[5:] == ["de"] * 3
    assert language.byte_labels(model, "\u00e92 ,")[2:] == [None] * 3


def test_odd_rows(spark, frame):
    model = language.trained([("en", [b"text", b"same", b"word"]), ("de", [b"\xc3\xa4pfel"])], steps=40)
    found = language.languages(frame(odd_rows()), model).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3) or r["doc_id"] is None and r["score"] == 0)
    assert {r["lang_pred"] for r in language.languages(frame([(1, "text")]), None).collect()} == {"und"}
    assert language.languages(frame([]), model).collect() == []
    kept = language.selected(frame(odd_rows()), model, 0.0)
    assert kept.columns == frame([]).columns and kept.count() == len(odd_rows()) - 4
    assert language.languages(frame([(1, "123 × — \U0001f600")]), model).first()["lang_pred"] == "und"


def test_nothing_to_learn_from(spark, frame):
    assert language.fit(frame([])) is None
    assert language.fit(frame([(1, "text")])) is None
    assert language.fit(frame([(1, None), (2, "12"), (2, "34")], "en")).languages == ["en"]


def test_numbers_are_no_letters():
    for text in ("² ½ 12", "Ⅷ", "①", "", "_ 7"):
        assert not language.has_letter(text)
    assert all(language.has_letter(t) for t in ("½ a", "中", "ª", "12 Ä"))


def test_all_of_a_long_word_is_learned():
    long = {"en": b"q" * 60 + b"th" * 45, "de": b"q" * 60 + b"sch" * 30}
    model = language.trained([(lang, [word]) for lang, word in long.items()], steps=200)
    for lang, word in long.items():
        assert language.byte_labels(model, word.decode())[60:] == [lang] * 90
