"""Minimal perfect hash over 64-bit keys: levels of bit fields, each holding the keys that meet no other there.

A key's slot is the number of set bits before its own. Every key of the set gets a slot of its own below the number
of keys; a strange key gets any slot or none, so that whoever looks up compares a fingerprint or the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Bits per key at each level; more bits make fewer levels.
GAMMA = 2.0
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP, _ALL = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer, another one for each seed."""
    x = keys + np.uint64((_STEP * (seed + 1)) & _ALL)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    sizes: list[int]
    bits: np.ndarray  # one byte per position, all levels
    ranks: np.ndarray  # set bits before each position

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64; equal ones can't be told apart and raise."""
        left, sizes, fields = keys.astype(np.uint64), [], []
        if len(np.unique(left)) != len(left):
            raise ValueError("the keys of a perfect hash must be distinct")
        while len(left):
            size = max(8, int(len(left) * GAMMA))
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            fields.append(alone)
            left = left[~alone[at]]
        return cls.from_bits(sizes, np.concatenate(fields) if fields else np.zeros(0, bool))

    @classmethod
    def from_bits(cls, sizes: list[int], bits: np.ndarray) -> PerfectHash:
        return cls(list(sizes), bits, np.cumsum(bits, dtype=np.int64) - bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that no level holds."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = self.bits[at]
            out[left[here]] = self.ranks[at[here]]
            left = left[~here]
            start += size
        return out

    @cached_property
    def _plain(self) -> tuple[list[tuple[int, int, int]], bytes, list[int]]:
        starts = np.cumsum([0, *self.sizes])[:-1].tolist()
        seeds = [(_STEP * (level + 1)) & _ALL for level in range(len(self.sizes))]
        return list(zip(starts, self.sizes, seeds, strict=True)), self.bits.astype(np.uint8).tobytes(), self.ranks.tolist()

    def slot(self, key: int) -> int:
        """The slot of one key, as slots() gives it."""
        levels, bits, ranks = self._plain
        for start, size, seed in levels:
            x = (key + seed) & _ALL
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
            at = start + (x ^ (x >> 31)) % size
            if bits[at]:
                return ranks[at]
        return -1
