"""Logistic mixing of hashed-context bit predictors, in numpy.

A text is coded word by word: the bytes of a word and a closing space, or one sign for the end of the text. Each bit is
predicted from six contexts: where the word starts, the last one to four bytes, and all bytes of the word so far. A
context is known by its full hash. How often each byte followed it gives how often a 0 and a 1 followed it and the bits
of the byte so far; these counts are gathered for each block of words, so no two contexts share any and there are as
many as the corpus has. The stretched frequencies are combined by weights, chosen by a gate from how many contexts are
known and how well, and a table of what became of such predictions refines the result.

Words that begin alike share their bits, so a block of words is worked on as the different steps through its words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from tablework.llm import common as C

# Slots of each context, as powers of two, in the table of a few blocks that nothing was gathered for.
SIZES = (10, 16, 18, 19, 20, 20)
OFFSETS = np.cumsum([0, *(1 << s for s in SIZES)])
SLOTS = int(OFFSETS[-1])
INPUTS = len(SIZES) + 1
LEVELS, DEPTHS = len(SIZES) + 1, 12
GATES = LEVELS * DEPTHS
BUCKETS = 33
RATE = 0.02
STEP_EDGES = 4096
END = b""
_CLOSE, _END, _PAD = 32, 10, 4
_LEAST = 1e-7


@dataclass
class Block:
    """The different steps through a block of words: a byte, what stands before it, and which words take it."""

    keys: np.ndarray  # (steps, contexts): the full hash of each context
    values: np.ndarray  # the byte of each step
    bits: np.ndarray  # (steps, 8)
    step_of: np.ndarray  # for each byte of all words
    starts: np.ndarray  # first byte of each word in ``step_of``

    @cached_property
    def slots(self) -> np.ndarray:
        """(steps, contexts, 8): places in a hashed table of ``SLOTS``; ``gathered`` puts those of its own table here."""
        slots = np.empty((*self.keys.shape, 8), np.int32)
        value = self.values.astype(np.uint64)
        for j in range(8):
            node = (np.uint64(1 << j) | (value >> np.uint64(8 - j))) * np.uint64(0x9E3779B97F4A7C15)
            for k, size in enumerate(SIZES):
                mixed = (self.keys[:, k] ^ node) * np.uint64(0xD6E8FEB86659FD93)
                slots[:, k, j] = (mixed >> np.uint64(64 - size)).astype(np.int32) + OFFSETS[k]
        return slots

    @cached_property
    def followed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different contexts in order, the different ``place of the context * 256 + byte`` in order, and which of
        these each step and context has."""
        contexts, rank = C.distinct(self.keys.ravel())
        pairs = rank.reshape(self.keys.shape) * 256 + self.values[:, None]
        pairs, at = C.distinct(pairs.ravel())
        return contexts, pairs, at.reshape(self.keys.shape)


def block(words: list[bytes]) -> Block:
    coded = [w + b" " if w else b"\n" for w in words]
    sizes = np.array([len(w) for w in coded], np.int64)
    data = np.frombuffer(b"".join(b"    " + w for w in coded), np.uint8)
    ends = np.cumsum(sizes + _PAD)
    starts = ends - sizes
    places = np.arange(int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    places = places - np.repeat(first, sizes) + np.repeat(starts, sizes)
    begin = np.repeat(starts, sizes)
    spans = C.byte_spans(data)
    steps, step_of = C.distinct(spans.hashes(begin, places + 1))
    # The first place of each step.
    chosen = np.empty(len(steps), np.int64)
    chosen[step_of[::-1]] = np.arange(len(step_of))[::-1]
    at, begin = places[chosen], begin[chosen]
    last = [data[at - i].astype(np.uint64) << np.uint64(8 * (i - 1)) for i in range(1, 5)]
    known = [
        (at == begin).astype(np.uint64),
        last[0],
        last[0] | last[1],
        last[0] | last[1] | last[2],
        last[0] | last[1] | last[2] | last[3],
        spans.hashes(begin, at),
    ]
    keys = np.stack([C.mixed(context + np.uint64(k << 56)) for k, context in enumerate(known)], 1)
    return Block(keys, data[at], np.unpackbits(data[at]).reshape(-1, 8), step_of, first)


def shared(b: Block) -> np.ndarray:
    """Of the block's different contexts, those that words of other blocks can have too.

    The words of a block are next to each other in order, so all words that begin with the same bytes are in it, unless
    its first or last word begins with them as well.
    """
    contexts, _, _ = b.followed
    edges = np.append(b.starts, len(b.step_of))
    outer = np.concatenate([b.step_of[: edges[1]], b.step_of[edges[-2] :]])
    inner = np.setdiff1d(b.keys[:, -1], b.keys[outer, -1])
    return ~np.isin(contexts, inner, assume_unique=True)


def pair_counts(b: Block, taken: np.ndarray) -> np.ndarray:
    """How often each different context of the block was followed by each byte in the block itself."""
    _, pairs, at = b.followed
    return np.bincount(at.ravel(), np.repeat(taken, at.shape[1]), len(pairs))


def gathered(b: Block, context: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The block's own table, from how often each of its contexts was followed by each byte anywhere."""
    contexts, pairs, at = b.followed
    held = np.searchsorted(contexts, context) * 256 + value
    order = np.argsort(held, kind="stable")
    held, sums = held[order], np.concatenate([[0], np.cumsum(count[order], dtype=np.float64)])

    def below(places):
        return sums[np.searchsorted(held, places)]

    low = pairs >> 8 << 8
    before, after = below(low), below(low + 256)
    table = np.empty((len(pairs), 8, 2), np.float32)
    for j in range(8):
        middle = low + (128 >> j)
        between = below(middle)
        table[:, j, 0], table[:, j, 1] = between - before, after - between
        one = (pairs >> (7 - j) & 1).astype(bool)
        low, before, after = np.where(one, middle, low), np.where(one, between, before), np.where(one, after, between)
    b.slots = (at[:, :, None] * 8 + np.arange(8)).astype(np.int32)
    return table.ravel()


def step_weights(b: Block, counts: np.ndarray) -> np.ndarray:
    """How often each step was taken, given how often each word was."""
    sizes = np.diff(np.append(b.starts, len(b.step_of)))
    return np.bincount(b.step_of, np.repeat(counts, sizes), len(b.bits))


def add_counts(table: np.ndarray, b: Block, taken: np.ndarray) -> None:
    """Add the steps to ``table``, of a 0 and a 1 count per slot, flat."""
    for k in range(len(SIZES)):
        places = 2 * b.slots[:, k] + b.bits
        low, high = 2 * int(OFFSETS[k]), 2 * int(OFFSETS[k + 1])
        table[low:high] += np.bincount(places.ravel() - low, np.repeat(taken, 8), high - low)


def _inputs(table: np.ndarray, b: Block, rows: slice, own: np.ndarray | None):
    """Stretched frequencies (contexts, bits) and the gate of each bit; ``own`` is 1 for steps that counted themselves."""
    slots, bits = b.slots[rows], b.bits[rows].ravel()
    x = np.empty((INPUTS, bits.size), np.float32)
    level = np.zeros(bits.size, np.int64)
    total = None
    left = np.repeat(own, 8).astype(np.float32) if own is not None else None
    # Both counts of a place are taken at once.
    table = np.ascontiguousarray(table, np.float32).view(np.complex64)
    for k in range(len(SIZES)):
        both = table.take(slots[:, k].ravel())
        zeros, ones = both.real, both.imag
        if left is not None:
            # What a step would have seen before it happened for the last time.
            zeros, ones = zeros - left * (1 - bits), ones - left * bits
        x[k] = np.log(ones + np.float32(0.4)) - np.log(zeros + np.float32(0.4))
        total = zeros + ones
        level += total > 0
    x[-1] = 0.3
    depth = np.minimum(DEPTHS - 1, np.log2(total + 1)).astype(np.int64)
    return np.clip(x, -12, 12, out=x), level * DEPTHS + depth, bits


def _mixed(weights: np.ndarray, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->j", weights.T.take(gate, axis=1), x)


def _squash(x):
    return 1 / (1 + np.exp(-x))


def first_weights() -> np.ndarray:
    weights = np.full((GATES, INPUTS), 0.1)
    weights[:, len(SIZES) - 1] = 0.6
    weights[:, -1] = 0
    return weights


def _bucket(mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return gate * BUCKETS + np.clip(np.rint(2 * mixed) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


def learn(table, weights, squares, outcomes, seen, b: Block, taken: np.ndarray) -> None:
    """Go through the steps once, predicting each group of them before the weights are changed by it.

    ``squares`` sums squared gradients and sets the rate of each weight, ``outcomes`` counts by gate and prediction what
    came, ``seen`` counts the bits of each gate. Steps that were never taken teach nothing; others count as often as
    they were taken.
    """
    steps = np.flatnonzero(taken > 0)
    order = np.random.default_rng(len(steps)).permutation(steps)
    for begin in range(0, len(order), STEP_EDGES):
        rows = order[begin : begin + STEP_EDGES]
        x, gate, bits = _inputs(table, b, rows, np.ones(len(rows)))
        force = np.repeat(taken[rows], 8)
        mixed = _mixed(weights, gate, x)
        outcomes += np.bincount(_bucket(mixed, gate) * 2 + bits, force, outcomes.size).reshape(outcomes.shape)
        error = (bits - _squash(np.clip(mixed, -16, 16))) * force
        mass = np.bincount(gate, force, GATES)
        seen += np.bincount(gate, minlength=GATES)
        for k in range(INPUTS):
            gradient = np.bincount(gate, error * x[k], GATES) / np.maximum(mass, 1e-9)
            squares[:, k] += gradient**2
            weights[:, k] += RATE * gradient / np.sqrt(squares[:, k] + 1e-6)


def refinement(outcomes: np.ndarray) -> np.ndarray:
    """The probability of a 1 for each gate and prediction, leaning on the prediction where little was seen."""
    prior = _squash((np.arange(BUCKETS) - BUCKETS // 2) / 2)
    prior = np.tile(np.clip(prior, 1e-4, 1 - 1e-4), GATES)
    return (outcomes[:, 1] + 8 * prior) / (outcomes.sum(1) + 8)


def word_scores(table, weights, refined, b: Block) -> np.ndarray:
    """log10 of the probability of each word."""
    steps = _step_scores(table, weights, refined, b)
    return np.add.reduceat(steps[b.step_of], b.starts) if len(b.starts) else np.zeros(0)


def rest_scores(table, weights, refined, b: Block) -> np.ndarray:
    """log10 of the probability of all of each word after its first byte."""
    steps = _step_scores(table, weights, refined, b)
    taken = steps[b.step_of]
    taken[b.starts] = 0
    return np.add.reduceat(taken, b.starts) if len(b.starts) else np.zeros(0)


def _step_scores(table, weights, refined, b: Block) -> np.ndarray:
    steps = np.empty(len(b.bits))
    for begin in range(0, len(steps), STEP_EDGES):
        rows = slice(begin, begin + STEP_EDGES)
        x, gate, bits = _inputs(table, b, rows, None)
        mixed = _mixed(weights, gate, x)
        one = (_squash(np.clip(mixed, -16, 16)) + refined[_bucket(mixed, gate)]) / 2
        one = np.clip(one, _LEAST, 1 - _LEAST)
        steps[rows] = np.log10(np.where(bits == 1, one, 1 - one)).reshape(-1, 8).sum(1)
    return steps
