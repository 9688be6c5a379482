"""HyperMinHash registers of shingle sets: leading-zero counts and mantissa bits of the least hash in each bucket.

A set of 64-bit hashes is dealt out to `BUCKETS` by the first bits. Of the least hash of a bucket a register keeps how
many zeros the rest begins with (6 bits) and the `MANTISSA` bits after the first one: 16 bits in place of 64. Two sets
of similarity J agree in a register with probability J, but for the rare case that different hashes look alike; that
share is taken off again (`similarity`). An empty bucket takes the register of the first bucket that isn't, in an order
of its own, so that small sets are compared on all registers, too.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

from schemaloom.llm.perfect_hash import mix

BUCKETS, MANTISSA = 128, 10
#: Registers of a band: a pair of similarity 0.85 misses all of 32 bands with probability 6e-11, of 0.8 with 5e-8.
ROWS = 4
BANDS = BUCKETS // ROWS
#: Expected share of agreeing registers of different hashes, for sets much larger than the number of buckets.
ALIKE = 0.1699 / (1 << MANTISSA)
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Words that a task remembers the hashes of, to save time.
REMEMBERED = 100_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = WordHashes()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `size` words; with fewer words, of all words as one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = each[:n].copy()
    for k in range(1, size):
        total = total * _MULTIPLIERS[0] + (each[k : k + n] ^ (total >> np.uint64(32)))
    return np.unique(mix(total, 5))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=2)).view(np.int64))


@cache
def _orders() -> np.ndarray:
    """For each bucket the order in which it looks for a register."""
    keys = mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64), 11).reshape(BUCKETS, BUCKETS)
    keys[np.arange(BUCKETS), np.arange(BUCKETS)] = 0
    return np.argsort(keys, axis=1)


_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - 7)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers for each set; sets must not be empty."""
    least = np.zeros((len(sets), BUCKETS), np.uint64)
    filled = np.zeros((len(sets), BUCKETS), bool)
    for row, hashes in enumerate(sets):
        at = np.searchsorted(hashes, _EDGES)
        there = np.append(at[1:], len(hashes)) > at
        least[row, there], filled[row] = hashes[at[there]], there
    rest = least << np.uint64(7)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    after = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | after).astype(np.uint16)
    open_ = np.flatnonzero(~filled.all(axis=1))
    for some in np.array_split(open_, max(1, len(open_) // 256)):
        if len(some):
            order = _orders()
            source = np.take_along_axis(order[None], filled[some][:, order].argmax(axis=2)[:, :, None], 2)[:, :, 0]
            out[some] = np.take_along_axis(out[some], source, 1)
    return out


def bands(rows: np.ndarray) -> np.ndarray:
    """Registers as signed 64-bit integers, one for each band."""
    return np.ascontiguousarray(rows).view("<i8")


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of registers (as bands or not), less what looks alike by chance."""
    a, b = (np.ascontiguousarray(x).view("<u2") for x in (a, b))
    return ((a == b).mean(axis=-1) - ALIKE) / (1 - ALIKE)


def least_estimate(percent: int, sizes: np.ndarray) -> np.ndarray:
    """Below this estimate a pair with a larger set of this size is not linked: five standard deviations off."""
    p = percent / 100
    return p - 5 * np.sqrt(p * (1 - p) / np.minimum(BUCKETS, np.maximum(1, sizes)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the similarity of two sorted sets is `percent` or more."""
    both = np.concatenate([a, b])
    both.sort()
    inner = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inner >= percent * (len(both) - inner)
