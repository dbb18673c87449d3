"""Mixing of bit predictors over running text: how each word begins after the words before it, in numpy.

The first byte of a word, or the end, is coded by the bits of a prefix code that the corpus gives, so that common bytes
take few of them. Each bit is predicted from the last one to four bytes of the text, the space after the last word being
one of them, by weights that are learned online and chosen by a gate from the place of the bit and how well the longest
context is known, and a table of what became of such predictions refines the result. This is then mixed with what
followed in the document so far and refined again, by weights, counts and outcomes of the document's own: it goes through
its tokens in order, a short group at a time, and what came changes what is predicted after it. The rest of a word comes
from ``mixing``. Beside the spelling stands the document's own list of words, with a share that follows how often it was
right.
"""

from __future__ import annotations

import heapq

import numpy as np

from tablework.llm import common as C
from tablework.llm import mixing as M

END = 10
INPUTS, BIAS = 5, 4
PLACES, LEVELS = 8, 6
GATES = PLACES * LEVELS
REFINED = GATES * M.BUCKETS
# First weights of a document: of the corpus, of the document so far, and a constant.
FIRST = (0.85, 0.2, 0.0)
# Tokens of a document by which it learns at a time: a few at first, more later.
GROUPS = (16, 32, 64, 128)
# Tokens that are looked up at a time, and bytes of what a task remembers of endings it has looked up.
CHUNK = 1 << 16
HELD_BYTES = 1 << 24
# How many outcomes of its own outweigh the prediction, and the share of a document's own words before any token.
LEAN = 30
SHARE = (4, 16)


class Code:
    """A prefix code of bytes. A node of its tree parts the bytes from ``low`` to ``high``, in tree order, at ``middle``."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(n) + 0.01, s, s) for s, n in enumerate(counts)]
        heapq.heapify(heap)
        number = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], number, (a[2], b[2])))
            number += 1
        self.leaf = np.zeros(len(counts), np.int64)
        nodes, paths, stack, at = [], [[] for _ in counts], [(heap[0][2], [])], 0
        while stack:
            tree, path = stack.pop()
            if isinstance(tree, int):
                self.leaf[tree], paths[tree] = at, path
                at += 1
            else:
                node = len(nodes)
                nodes.append(tree)
                stack += [(tree[1], [*path, (node, 1)]), (tree[0], [*path, (node, 0)])]
        self.lengths = np.array([len(p) for p in paths])
        self.node = np.zeros((len(counts), self.lengths.max()), np.int32)
        self.bit = np.zeros(self.node.shape, np.int32)
        limits = np.array([[len(counts), 0, 0]] * len(nodes))
        for s, path in enumerate(paths):
            for j, (node, bit) in enumerate(path):
                self.node[s, j], self.bit[s, j] = node, bit
                low, high, zeros = limits[node]
                limits[node] = min(low, self.leaf[s]), max(high, self.leaf[s] + 1), zeros + 1 - bit
        low, high, zeros = limits.T
        # Bytes that were never learned have no column: nothing stands before or after them that does not anyway.
        held = np.zeros(len(counts), np.int64)
        held[self.leaf] = np.asarray(counts) > 0
        column = np.concatenate([[0], np.cumsum(held)])
        self.width = int(column[-1]) + 1
        self.low, self.middle, self.high = (column[a].astype(np.int32) for a in (low, low + zeros, high))
        self.leaf = column[self.leaf]
        self.depth = np.zeros(len(nodes), np.int32)
        for s, path in enumerate(paths):
            self.depth[self.node[s, : len(path)]] = np.arange(len(path))

    def bits(self, symbols: np.ndarray):
        """For each bit of the symbols' codes: which symbol, its place in the code, its node and itself."""
        sizes = self.lengths[symbols]
        first = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(symbols), dtype=np.int32), sizes)
        place = np.arange(len(of), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
        at = np.repeat(symbols.astype(np.int32) * self.node.shape[1], sizes) + place
        return of, place, self.node.ravel()[at], self.bit.ravel()[at]

    def below(self, rows: np.ndarray, symbols: np.ndarray, counts: np.ndarray, height: int) -> np.ndarray:
        """(height, width): for each row, how many of its counts stand before each place of the tree order."""
        # Whole numbers below 2 ** 24 are exact in single precision.
        kind = np.float32 if counts.sum(dtype=float) < 1 << 24 else np.float64
        table = np.zeros(height * self.width, kind)
        np.add.at(table, rows * self.width + self.leaf[symbols] + 1, counts.astype(kind))
        return np.cumsum(table.reshape(height, self.width), 1)


def stretched(zeros, ones):
    x = np.log(np.asarray(ones, np.float32) + np.float32(0.4)) - np.log(np.asarray(zeros, np.float32) + np.float32(0.4))
    return np.clip(x, -12, 12, out=x)


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last three bytes before the space after each word, the very last one being the highest."""
    sizes, out = ends - starts, np.zeros(len(starts), np.int64)
    for i in range(1, 4):
        byte = np.where(sizes == i - 1, 32, END)
        byte[sizes == 0] = END
        held = sizes >= i
        byte[held] = data[ends[held] - i]
        out |= byte << (24 - 8 * i)
    return out


class Border:
    """What the corpus says of how words begin, from how often each byte followed each ending, in order of endings."""

    def __init__(self, of: np.ndarray, symbols: np.ndarray, counts: np.ndarray):
        self.code = Code(np.bincount(symbols, counts, 256))
        self.known, first = np.unique(of, return_index=True)
        self.places = np.append(first, len(of))
        self.symbols, self.counts = symbols, counts
        self.shorter, self.rows = [], []
        for shift in (24, 16, 8):
            known, rows = np.unique(of >> shift, return_inverse=True)
            self.rows.append(known)
            self.shorter.append(stretched(*self._parted(rows, symbols, counts, len(known) + 1)))

    def _parted(self, rows, symbols, counts, height):
        """(height, nodes): how often each row's symbols went to either side of each node."""
        code = self.code
        # A few rows at a time, as the sums are long ones.
        zeros, ones = (np.empty((height, len(code.low)), np.float32) for _ in range(2))
        for a in range(0, height, 4096):
            s = slice(*np.searchsorted(rows, (a, a + 4096)))
            sums = code.below(rows[s] - a, symbols[s], counts[s], min(height - a, 4096))
            middle = sums[:, code.middle]
            zeros[a : a + 4096], ones[a : a + 4096] = middle - sums[:, code.low], sums[:, code.high] - middle
        return zeros, ones

    def followed(self, used: np.ndarray):
        """(endings, nodes): how often each side of each node followed each of some endings, in order."""
        at = np.minimum(np.searchsorted(self.known, used), max(0, len(self.known) - 1))
        held = self.known[at] == used if len(self.known) else np.zeros(len(used), bool)
        sizes = np.where(held, self.places[at + 1] - self.places[at], 0) if len(self.known) else np.zeros(len(used), int)
        entry = np.arange(sizes.sum()) + np.repeat(self.places[at] - np.cumsum(sizes) + sizes, sizes)
        rows = np.repeat(np.arange(len(used)), sizes)
        return self._parted(rows, self.symbols[entry], self.counts[entry], len(used))

    def short(self, used: np.ndarray) -> list[np.ndarray]:
        """The rows of the three shorter contexts of endings; the last row of each is of contexts never learned."""
        out = []
        for known, shift in zip(self.rows, (24, 16, 8)):
            at = np.searchsorted(known, used >> shift)
            inside = np.minimum(at, max(0, len(known) - 1))
            held = known[inside] == used >> shift if len(known) else np.zeros(len(used), bool)
            out.append(np.where(held, inside, len(known)))
        return out

    def gates(self, node, zeros, ones):
        level = np.minimum(LEVELS - 1, np.log2(np.maximum(zeros + ones, 0) + 1)).astype(np.int32)
        return np.minimum(PLACES - 1, self.code.depth[node]) * LEVELS + level

    def logits(self, used: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
        """(endings, nodes): the stretched probability of a 1, mixed and refined, for some endings."""
        zeros, ones = self.followed(used)
        gate = self.gates(np.arange(len(self.code.low)), zeros, ones)
        weights = weights.astype(np.float32).T
        mixed = weights[3][gate] * stretched(zeros, ones) + np.float32(0.3) * weights[BIAS][gate]
        for k, (table, rows) in enumerate(zip(self.shorter, self.short(used))):
            mixed += weights[k][gate] * table[rows]
        mixed = np.clip(mixed, -16, 16, out=mixed)
        one = (_squash(mixed) + refined.astype(np.float32)[gate * M.BUCKETS + _bucket(mixed)]) / 2
        one = np.clip(one, np.float32(M._LEAST), np.float32(1 - M._LEAST))
        return np.log(one / (1 - one))


class Lookup:
    """The logits of endings, each computed once as long as they are few enough to be held."""

    def __init__(self, border: Border, weights: np.ndarray, refined: np.ndarray):
        self.border, self.weights, self.refined = border, weights, refined
        self.most = HELD_BYTES // (4 * max(1, len(border.code.low)))
        self._forget()

    def _forget(self) -> None:
        self.known, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table = np.zeros((0, len(self.border.code.low)), np.float32)

    def places(self, used: np.ndarray) -> np.ndarray:
        """The rows of ``table`` that hold some different endings, in order. They hold until the next call."""
        new = np.setdiff1d(used, self.known, assume_unique=True)
        if len(self.known) and len(self.known) + len(new) > self.most:
            self._forget()
            new = used
        if len(new):
            begin, end = len(self.known), len(self.known) + len(new)
            if end > len(self.table):
                room = max(end, min(2 * len(self.table), self.most)) - len(self.table)
                self.table = np.concatenate([self.table, np.empty((room, self.table.shape[1]), np.float32)])
            self.table[begin:end] = self.border.logits(new, self.weights, self.refined)
            self.known = np.concatenate([self.known, new])
            self.rows = np.concatenate([self.rows, np.arange(begin, end)])
            order = np.argsort(self.known, kind="stable")
            self.known, self.rows = self.known[order], self.rows[order]
        return self.rows[np.searchsorted(self.known, used)]


def first_weights() -> np.ndarray:
    weights = np.full((GATES, INPUTS), 0.2)
    weights[:, 3] = 0.4
    weights[:, BIAS] = 0
    return weights


def _squash(x):
    return 1 / (1 + np.exp(-x))


def _bucket(mixed: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(2 * mixed) + M.BUCKETS // 2, 0, M.BUCKETS - 1).astype(np.int32)


def learn(weights, squares, outcomes, seen, border: Border, of, symbols, counts) -> None:
    """Predict what followed some endings, each as often as it did, before the weights are changed by it."""
    used, at = np.unique(of, return_inverse=True)
    zeros, ones = border.followed(used)
    entry, _, node, bit = border.code.bits(symbols)
    row, force = at[entry], counts[entry]
    # What was known before it happened for the last time.
    zeros, ones = zeros[row, node] - (1 - bit), ones[row, node] - bit
    gate = border.gates(node, zeros, ones)
    x = np.full((INPUTS, len(node)), 0.3, np.float32)
    x[3] = stretched(np.maximum(zeros, 0), np.maximum(ones, 0))
    for k, (table, rows) in enumerate(zip(border.shorter, border.short(used))):
        x[k] = table[rows[row], node]
    mixed = np.clip(_mixed(weights.astype(np.float32).T[:, gate], x), -16, 16)
    outcomes += np.bincount((gate * M.BUCKETS + _bucket(mixed)) * 2 + bit, force, outcomes.size).reshape(outcomes.shape)
    error = (bit - _squash(mixed)) * force
    mass = np.bincount(gate, force, GATES)
    seen += mass
    for k in range(INPUTS):
        gradient = np.bincount(gate, error * x[k], GATES) / np.maximum(mass, 1e-9)
        squares[:, k] += gradient**2
        weights[:, k] += M.RATE * gradient / np.sqrt(squares[:, k] + 1e-6)


def _mixed(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->j", weights, x)


def refinement(outcomes: np.ndarray) -> np.ndarray:
    """The probability of a 1 for each gate and prediction, leaning on the prediction where little was seen."""
    prior = M._squash((np.arange(M.BUCKETS) - M.BUCKETS // 2) / 2)
    prior = np.tile(np.clip(prior, 1e-4, 1 - 1e-4), GATES)
    return (outcomes[:, 1] + 8 * prior) / (outcomes.sum(1) + 8)


def _ordered(numbers: np.ndarray) -> np.ndarray:
    """The order of whole numbers, equal ones as they come; short ones are sorted in linear time."""
    return np.argsort(numbers.astype(np.uint16) if numbers.max(initial=0) < 1 << 16 else numbers, kind="stable")


def earlier(sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How often each token's word stands before it in its document; ``sizes`` are tokens of the documents."""
    order = _ordered(words)
    # Tokens of a word come in order of the documents.
    docs, held = np.repeat(np.arange(len(sizes)), sizes)[order], words[order]
    new = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (held[1:] != held[:-1])))
    out = np.empty(len(words), np.int64)
    out[order] = np.arange(len(words)) - np.repeat(new, np.diff(np.append(new, len(words))))
    return out


def document_scores(lookup: Lookup, sizes, words, symbols, ends, rests, earlier) -> np.ndarray:
    """log10 of the probability of each document.

    ``sizes`` are tokens of the documents, the end included; ``words`` and ``symbols`` the number and first byte of each
    token, and ``earlier`` how often its word stands before it in its document. ``ends`` (endings) and ``rests`` (log10 of
    the probability of all after the first byte) go by the number of the word; number 0 is the end, which also stands
    before each document.
    """
    code = lookup.border.code
    count, first = len(sizes), np.cumsum(sizes) - sizes
    docs = np.repeat(np.arange(count), sizes)
    at = np.arange(len(words)) - first[docs]
    before = np.empty_like(words)
    before[1:], before[first] = words[:-1], 0
    limits = np.concatenate([[0], np.cumsum([*GROUPS])])
    longest = int(sizes.max(initial=0))
    limits = np.append(limits, np.arange(limits[-1] + GROUPS[-1], longest + GROUPS[-1], GROUPS[-1]))
    group = np.searchsorted(limits, at, "right") - 1
    order = _ordered(group)
    docs, at, words, symbols, before, earlier = (a[order] for a in (docs, at, words, symbols, before, earlier))
    borders = np.searchsorted(group[order], np.arange(group.max(initial=-1) + 2))
    nodes = len(code.low)
    used, row = C.distinct(ends)
    own_weights = np.tile(np.array(FIRST, np.float32)[:, None], count)
    squares = np.full(own_weights.shape, 1e-3, np.float32)
    # Zeros, then ones.
    own = np.zeros((2, count * nodes), np.float32)
    came = np.zeros((2, count * M.BUCKETS), np.float32)
    right = np.zeros(count)
    scores = np.zeros(count)
    tail = rests[words] / np.log10(np.e)
    ahead = 0
    for a, b in zip(borders[:-1], borders[1:]):
        if b > ahead:
            # What the corpus gives, for as many groups as make a chunk.
            begin, end = a, int(borders[max(np.searchsorted(borders, a + CHUNK, "right") - 1, np.searchsorted(borders, b))])
            s = slice(begin, end)
            here = row[before[s]]
            some = np.flatnonzero(np.bincount(here, minlength=len(used)))
            places = np.zeros(len(used), np.int64)
            places[some] = lookup.places(used[some]) * nodes
            _, _, node_of, bit_of = code.bits(symbols[s])
            lengths = code.lengths[symbols[s]]
            corpus = lookup.table.ravel().take(np.repeat(places[here], lengths) + node_of)
            ahead = end
            limit = np.concatenate([[0], np.cumsum(lengths)])
        s = slice(limit[a - begin], limit[b - begin])
        node, bit = node_of[s], bit_of[s]
        tokens = limit[a - begin : b - begin] - limit[a - begin]
        # The documents of the group, their first bits and how many.
        who = docs[a:b]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        some, first = who[first], tokens[first]
        each = np.diff(np.append(first, len(node)))
        leaf = np.repeat(some * nodes, each) + node
        x = np.full((3, len(node)), 0.3, np.float32)
        x[0] = corpus[s]
        x[1] = stretched(own[0].take(leaf), own[1].take(leaf))
        mixed = np.clip(_mixed(np.repeat(own_weights[:, some], each, axis=1), x), -16, 16)
        even = _squash(mixed)
        place = np.repeat(some * M.BUCKETS, each) + _bucket(mixed)
        zeros, ones = came[0].take(place), came[1].take(place)
        one = (LEAN * even + ones) / (LEAN + zeros + ones)
        one = np.clip((even + one) / 2, np.float32(M._LEAST), np.float32(1 - M._LEAST))
        spelt = np.log(np.where(bit == 1, one, 1 - one))
        spelt = np.add.reduceat(spelt, tokens, dtype=float) + tail[a:b]
        # The document's own words: as likely as they were often, by a share for how often that was right.
        ago = at[a:b]
        share = (right[who] + SHARE[0]) / (limits[group[order[a]]] + SHARE[1])
        with np.errstate(divide="ignore"):
            listed = np.log(share) + np.log(earlier[a:b] / np.maximum(ago, 1))
        spelt = np.logaddexp(listed, np.log1p(-share) + spelt)
        scores += np.bincount(who, spelt, count)
        right += np.bincount(who, np.exp(listed - spelt), count)
        gradient = np.add.reduceat((bit.astype(np.float32) - even) * x, first, axis=1, dtype=float) / each
        squares[:, some] += gradient**2
        own_weights[:, some] += M.RATE * gradient / np.sqrt(squares[:, some] + 1e-6)
        np.add.at(own.ravel(), leaf + bit * np.int64(own.shape[1]), np.float32(1))
        np.add.at(came.ravel(), place + bit * np.int64(came.shape[1]), np.float32(1))
    return scores * np.log10(np.e)
