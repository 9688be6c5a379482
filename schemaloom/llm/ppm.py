"""Prediction by partial matching over bytes: a trie of contexts, escapes with symbol exclusion, log probabilities.

The trie holds contexts of 0 to `ORDER` bytes with the counts of what follows them. A byte that has followed its
longest known context c times among n has probability c / (n + d), where d is the number of different bytes seen there
(escape method C). Otherwise the model escapes with d / (n + d) to the context that is one byte shorter, where the
bytes already excluded count no more; below the empty context all bytes left are equally likely. Byte 255, which no
text in UTF-8 holds, begins and ends a text, so that the probabilities of all texts sum to one.

Because every byte seen after a context was also seen after the shorter one, what is excluded at one level is exactly
what the next longer context holds. So exclusion needs two sums per context and the whole score is array arithmetic.

Counts are gathered from all training texts by one aggregation, and all of them are kept: `lm_scores.probabilities`
is this model as joins over tables that grow with the input, `Trie` the same for counts that fit into memory. Sent to
executors is only a cache of the most frequent sequences with their exact probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

ORDER = 4
#: Sequences that make up a 2^-CACHE_BITS share of all bytes are cached; the others are joined.
CACHE_BITS = 20
EDGE = b"\xff"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of order + 1 bytes that end at each byte and at the end of each text; where each text's codes begin.

    Between two texts lie `order` codes that belong to none; positions[2k] to positions[2k + 1] are those of text k.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = EDGE * order
    data = np.frombuffer(pad + (EDGE + pad).join(texts) + EDGE, np.uint8)
    codes = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        codes <<= np.uint64(8)
        codes |= data[k : len(data) - order + k]
    lengths = np.array([len(x) for x in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1 + order)[:-1]])
    return codes, np.stack([begins, begins + lengths + 1], axis=1).ravel()


def count_grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the texts and their counts."""
    codes, at = grams(texts, order)
    own = np.ones(len(codes), bool)
    for end, begin in zip(at[1::2].tolist(), at[2::2].tolist()):
        own[end:begin] = False
    return np.unique(codes[own], return_counts=True)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal codes."""
    codes, where = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


class Table:
    """Hash table from codes to numbers."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values

    def __getstate__(self) -> tuple:
        return self.codes, self.values

    def __setstate__(self, state: tuple) -> None:
        self.codes, self.values = state

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray, int]:
        codes, values = self.codes, self.values
        bits = max(4, int(np.ceil(np.log2(max(1, len(codes))))) + 2)
        keys, held = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << bits)
        left, slots = np.arange(len(codes)), _slots(codes, bits)
        while len(left):
            free = keys[slots] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            keys[slots[put]], held[slots[put]] = codes[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slots = left[stay], (slots[stay] + 1) & ((1 << bits) - 1)
        return keys, held, bits

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each code, and the places of the codes that have none."""
        keys, held, bits = self.slots
        slots = _slots(codes, bits)
        at = keys[slots]
        out = held[slots]
        left = np.flatnonzero(at != codes)
        missing = [np.zeros(0, np.int64)]
        slots = slots[left]
        while len(left):
            empty = keys[slots] == np.uint64(0xFFFFFFFFFFFFFFFF)
            missing.append(left[empty])
            left, slots = left[~empty], (slots[~empty] + 1) & ((1 << bits) - 1)
            hit = keys[slots] == codes[left]
            out[left[hit]] = held[slots[hit]]
            left, slots = left[~hit], slots[~hit]
        return out, np.concatenate(missing)


class Trie:
    """levels[k]: sorted codes of k + 1 bytes (a context of k bytes and what follows) and their counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = [(np.asarray(c, np.uint64), np.asarray(n, np.float64)) for c, n in levels]
        self.order = len(levels) - 1

    def __getstate__(self) -> tuple:
        return self.levels, self.order

    def __setstate__(self, state: tuple) -> None:
        self.levels, self.order = state

    @cached_property
    def nodes(self) -> list[tuple[np.ndarray, ...]]:
        """For each level: contexts, n, d, and the sum of the next shorter context's counts over the same bytes."""
        out = []
        for k, (codes, n) in enumerate(self.levels):
            contexts, first, d = np.unique(codes >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(n) else n
            shorter = np.zeros(len(codes))
            if k:
                shorter = _found(*self.levels[k - 1], codes & _mask(k))[0]
            out.append((contexts, total, d.astype(np.float64), np.add.reduceat(shorter, first) if len(n) else n))
        return out

    @cached_property
    def table(self) -> Table:
        """From codes of the longest contexts to log10 of their probability."""
        codes, n = self.levels[-1]
        contexts, total, d, _ = self.nodes[-1]
        at = np.searchsorted(contexts, codes >> np.uint64(8))
        return Table(codes, np.log10(n / (total[at] + d[at])) if len(codes) else n)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last byte after the bytes before it."""
        out, at = self.table.find(codes)
        if len(at):
            unseen, where = np.unique(codes[at], return_inverse=True)
            out[at] = self.escaped(unseen)[where]
        return out

    def escaped(self, codes: np.ndarray) -> np.ndarray:
        """The same for any codes, level by level."""
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        ex_n, ex_d = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(self.order, -1, -1):
            contexts, total, d, shorter = self.nodes[k]
            if not len(contexts):
                continue
            context = (codes >> np.uint64(8)) & _mask(k)
            node = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            there = open_ & (contexts[node] == context)
            n_left, d_left = total[node] - ex_n, d[node] - ex_d
            count, found = _found(*self.levels[k], codes & _mask(k + 1))
            hit, escape = there & found, there & ~found
            out[hit] += np.log10(count[hit] / (n_left[hit] + d_left[hit]))
            some = escape & (d_left > 0)
            out[some] += np.log10(d_left[some] / (n_left[some] + d_left[some]))
            ex_n[escape], ex_d[escape] = shorter[node[escape]], d[node[escape]]
            open_ &= ~hit
        out[open_] -= np.log10(256 - ex_d[open_])
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text."""
        if not texts:
            return np.zeros(0)
        codes, at = grams(texts, self.order)
        return np.add.reduceat(self.log10(codes), at[at < len(codes)])[::2]


def cached_scores(texts: list[bytes], cache: Table, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text the sum of the numbers its codes have in the cache; owner, code and times of the other codes."""
    if not texts:
        return np.zeros(0), [np.zeros(0, np.int64)] * 3
    codes, at = grams(texts, order)
    values, missing = cache.find(codes)
    values[missing] = 0
    place = np.searchsorted(at, missing, "right") - 1
    own = place % 2 == 0  # odd places lie between two texts
    owner, first = place[own] // 2, codes[missing[own]]
    by = np.lexsort((first, owner))
    owner, first = owner[by], first[by]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])])[: len(owner)])
    rest = [owner[new], first[new].astype(np.int64), np.diff(np.append(new, len(owner)))]
    return np.add.reduceat(values, at[at < len(codes)])[::2], rest


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)


def _found(codes: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    found = codes[at] == wanted
    return np.where(found, n[at], 0.0), found


def by_bytes(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes, at least one text each."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, at
            start, held = at, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
