"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads words, runs of letters, each with a space before it, in both directions and gives every byte a
probability for each language; a document's probabilities are the mean over the bytes of its letters. It is trained by backpropagation
through time on a bounded sample of labelled rows: the ``TRAIN_ROWS`` rows of each language that come first by a hash of
their id, and of each of these the ``TRAIN_WORDS`` different words that come first by a hash. Prediction reads all words
of all texts. Words come back often, so a worker labels a word once and remembers the sum over its bytes, from task
to task; that changes no result, as the network starts anew at every word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.llm import common as C
from tablework.session import stage

TRAIN_ROWS = 256
TRAIN_WORDS = 128
UNITS = 16
STEPS = 700
BATCH = 256
RATE = 0.01
# Longer words are read in runs of so many bytes.
LONGEST = 30
KNOWN_WORDS = 200_000
UNKNOWN = "und"

# A word is a run of letters: a-z, A-Z in lower case, and all bytes of characters beyond ASCII.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
# Letters and numbers that are no decimal digits, of which only the former are letters.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30, out=x)))


class Network:
    """The weights, the labels of bytes and one step of training."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 0):
        self.languages, self.units = languages, units
        draw = np.random.default_rng(seed)
        self.weights = {"out": draw.normal(0, 0.2, (2 * units, len(languages))), "bias": np.zeros(len(languages))}
        for way in ("f", "b"):
            self.weights["in" + way] = draw.normal(0, 0.3, (256, 3 * units))
            self.weights["gates" + way] = draw.normal(0, units**-0.5, (units, 2 * units))
            self.weights["state" + way] = draw.normal(0, units**-0.5, (units, units))
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        self.steps = 0

    def _read(self, words: np.ndarray, way: str, trace: list | None = None) -> np.ndarray:
        """States after each byte; ``words`` has one row per word."""
        w, n = self.weights, self.units
        state = np.zeros((len(words), n), w["bias"].dtype)
        states = np.empty((words.shape[1], len(words), n), state.dtype)
        order = range(words.shape[1])
        for t in order if way == "f" else reversed(order):
            inputs = w["in" + way][words[:, t]]
            gates = _sigmoid(inputs[:, : 2 * n] + state @ w["gates" + way])
            update, reset = gates[:, :n], gates[:, n:]
            new = np.tanh(inputs[:, 2 * n :] + (reset * state) @ w["state" + way])
            if trace is not None:
                trace.append((t, state, update, reset, new))
            state = state + update * (new - state)
            states[t] = state
        return states

    def probabilities(self, words: np.ndarray) -> np.ndarray:
        """(words, bytes, languages)."""
        both = np.concatenate([self._read(words, "f"), self._read(words, "b")], 2)
        return self._soft(both).transpose(1, 0, 2)

    def _soft(self, both):
        scores = both @ self.weights["out"] + self.weights["bias"]
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        return scores / scores.sum(-1, keepdims=True)

    def gradients(self, words: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all bytes, and its gradients by backpropagation through time."""
        n, w = self.units, self.weights
        traces = {"f": [], "b": []}
        both = np.concatenate([self._read(words, way, traces[way]) for way in "fb"], 2)
        soft = self._soft(both)
        rows = np.arange(len(words))
        loss = -float(np.log(soft[:, rows, labels] + 1e-9).mean())
        error = soft
        error[:, rows, labels] -= 1
        error /= error.shape[0] * error.shape[1]
        grads = {"out": np.einsum("tbi,tbj->ij", both, error), "bias": error.sum((0, 1))}
        back = error @ w["out"].T
        for way, part in (("f", slice(0, n)), ("b", slice(n, None))):
            inward = np.zeros_like(w["in" + way])
            gates_g, state_g = np.zeros_like(w["gates" + way]), np.zeros_like(w["state" + way])
            flow = np.zeros((len(words), n), np.float32)
            for t, state, update, reset, new in reversed(traces[way]):
                flow = flow + back[t][:, part]
                d_new = flow * update * (1 - new * new)
                d_held = d_new @ w["state" + way].T
                d_update = flow * (new - state) * update * (1 - update)
                d_reset = d_held * state * reset * (1 - reset)
                d_gates = np.concatenate([d_update, d_reset], 1)
                state_g += (reset * state).T @ d_new
                gates_g += state.T @ d_gates
                np.add.at(inward, words[:, t], np.concatenate([d_gates, d_new], 1))
                flow = flow * (1 - update) + d_held * reset + d_gates @ w["gates" + way].T
            grads |= {"in" + way: inward, "gates" + way: gates_g, "state" + way: state_g}
        return loss, grads

    def learn(self, words: np.ndarray, labels: np.ndarray, rate: float) -> float:
        """One step of Adam."""
        loss, grads = self.gradients(words, labels)
        self.steps += 1
        for name, grad in grads.items():
            first, second = self.moments[name]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            scale = rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            self.weights[name] -= (scale * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
        return loss

    def label_words(self, words: list[bytes]) -> np.ndarray:
        """For each word the sums of its bytes' probabilities, and the number of these bytes."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        pieces = -(-sizes // LONGEST)
        owner = np.repeat(np.arange(len(words)), pieces)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
        first, sizes = starts[owner] + inside, np.minimum(sizes[owner] - inside, LONGEST)
        sums = np.empty((len(owner), len(self.languages) + 1), np.float32)
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for begin in range(0, len(group), 2048):
                some = group[begin : begin + 2048]
                size = int(sizes[some[0]])
                table = np.full((len(some), size + 1), 32, np.uint8)
                table[:, 1:] = data[first[some][:, None] + np.arange(size)]
                sums[some, :-1] = self.probabilities(table)[:, 1:].sum(1)
                sums[some, -1] = size
        return np.add.reduceat(sums, np.cumsum(pieces) - pieces)


def _table(words: list[bytes], size: int) -> np.ndarray:
    """Words of one size as rows of bytes, each after a space."""
    body = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
    return np.concatenate([np.full((len(words), 1), 32, np.uint8), body], 1)


def byte_labels(model: Network, text: str) -> list[str | None]:
    """The language of every byte of a text; what is no letter has none."""
    data = text.encode()
    labels: list[str | None] = [None] * len(data)
    for word in re.finditer(rb"[^ ]+", data.translate(_WORDS)):
        for start in range(word.start(), word.end(), LONGEST):
            run = data.translate(_WORDS)[start : min(start + LONGEST, word.end())]
            best = model.probabilities(_table([run], len(run)))[0, 1:].argmax(1)
            labels[start : start + len(run)] = [model.languages[i] for i in best]
    return labels


def _runs(words: Iterable[bytes]) -> Iterator[bytes]:
    """Words in runs of up to ``LONGEST`` bytes, as they are labelled."""
    return (word[i : i + LONGEST] for word in words for i in range(0, len(word), LONGEST))


def trained(samples: list[tuple[str, list[bytes]]], steps: int = STEPS) -> Network | None:
    """A network from (language, words) pairs; None if there are none."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    model, number = Network(languages), {lang: i for i, lang in enumerate(languages)}
    by_size: dict[int, list[tuple[bytes, int]]] = {}
    for lang, words in sorted(samples):
        for run in _runs(words):
            by_size.setdefault(len(run), []).append((run, number[lang]))
    if not by_size:
        return model
    groups = [(_table([w for w, _ in g], size), np.array([i for _, i in g])) for size, g in sorted(by_size.items())]
    share = np.array([t.size for t, _ in groups], float)
    draw = np.random.default_rng(1)
    for step, group in enumerate(draw.choice(len(groups), steps, p=share / share.sum())):
        table, labels = groups[group]
        rows = draw.integers(0, len(table), min(BATCH, len(table)))
        model.learn(table[rows], labels[rows], RATE * min(1.0, 2 * (1 - step / steps)))
    return model


def _training_words(batches):
    for batch, data, offsets in C.slices(batches):
        words = []
        for a, b in zip(offsets, offsets[1:]):
            different = sorted(set(_runs(set(data[a:b].tobytes().translate(_WORDS).split()))))
            if len(different) > TRAIN_WORDS:
                spread = C.mixed(np.arange(len(different), dtype=np.uint64))
                different = [different[i] for i in np.sort(np.argsort(spread, kind="stable")[:TRAIN_WORDS])]
            words.append(different)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.binary()))], ["lang", "words"])


def held_out(id_column: F.Column, parts: int, part: int) -> F.Column:
    """Whether the checksum of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == part, F.lit(False))


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Network | None:
    """A network from a bounded sample of the rows that have a language."""
    rows = labelled.filter(col(lang_column).isNotNull() & col(text_column).isNotNull())
    rows = rows.select(
        col(lang_column).cast("string").alias("lang"),
        F.xxhash64(col(id_column).cast("string")).alias("order"),
        col(text_column).cast("string").alias("text"),
    )
    # The ids are chosen without the texts; then again with them, as rows may repeat an id.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    chosen = rows.select("lang", "order").distinct().withColumn("place", place).filter(F.col("place") <= TRAIN_ROWS)
    chosen = C.sized(stage(chosen.select("lang", "order"), "chosen"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    sample = (
        rows.join(chosen, ["lang", "order"], "left_semi")
        .withColumn("place", place)
        .filter(F.col("place") <= TRAIN_ROWS)
        .select("lang", "text")
        .mapInArrow(_training_words, "lang string, words array<binary>")
    )
    return trained([(r["lang"], [bytes(w) for w in r["words"]]) for r in sample.collect()])


class Reader:
    """A network in a worker, with the words it has labelled."""

    def __init__(self, network: Network):
        self.network, self.known = network, {}
        self.sums = np.zeros((1024, len(network.languages) + 1), np.float32)

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sums over its words, as of ``label_words``."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        words = [t.translate(_WORDS).split() for t in texts]
        found = [list(map(known.get, ws)) for ws in words]
        new = list({w for ws, ids in zip(words, found) if None in ids for w, i in zip(ws, ids) if i is None})
        if new:
            begin, end = len(known), len(known) + len(new)
            if end > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((end, self.sums.shape[1]), np.float32)])
            self.sums[begin:end] = self.network.label_words(new)
            known.update(zip(new, range(begin, end)))
            found = [list(map(known.get, ws)) if None in ids else ids for ws, ids in zip(words, found)]
        return np.array([self.sums[ids].sum(0, dtype=np.float64) for ids in found])


def _reader(network: Network) -> Reader:
    """The worker's reader for a network, which keeps what it knows from task to task."""
    key = b"".join(network.weights[name].tobytes() for name in sorted(network.weights))
    return C.remembered(("language", key), lambda: Reader(network))


def _predictor(model):
    def run(batches):
        network: Network | None = model.value
        reader = _reader(network) if network else None
        for batch, data, offsets in C.slices(batches, keep=True):
            names, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
            texts = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            for i, total in enumerate(reader.totals(texts) if reader else ()):
                if total[-1] and has_letter(texts[i].decode("utf-8", "replace")):
                    best = int(total[:-1].argmax())
                    names[i], scores[i] = network.languages[best], min(1.0, float(total[best] / total[-1]))
            kept = [n for n in range(batch.num_columns) if batch.schema.names[n] != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*(batch.schema.names[n] for n in kept), "lang_pred", "score"],
            )

    return run


def languages(
    docs: DataFrame, model: Network | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. A tie goes to the language
    that comes first in order. Repeated rows are judged each; no rows in, no rows out; other columns are not read.
    """
    source = C.texts(docs, id_column, text_column)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, lang_pred string, score double"
    return source.mapInArrow(_predictor(held), schema)


def selected(docs: DataFrame, model: Network | None, least: float) -> DataFrame:
    """The rows of ``docs``, as they are, whose text has a language with a score of ``least`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    # The text goes twice: once to be read, once to come back as it was.
    read = docs.select(F.struct("*").alias("whole"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = read.schema["whole"].dataType.simpleString()
    judged = read.mapInArrow(_predictor(held), f"whole {kinds}, lang_pred string, score double")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("whole.*")
