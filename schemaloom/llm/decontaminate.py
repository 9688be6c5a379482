"""Benchmark items in documents: q-gram lemma over diagonal bands, verified by banded alignment.

Texts are compared in lower case with every run of white space as one space. An item of L characters is found where
some stretch of a document is within floor(L * `EDITS`) edits of the whole item.

1. Seeds: such a stretch leaves one of e + 1 equal pieces of the item unchanged, so that a document without any piece
   needs no further look. Pieces are looked up by rolling hash for all positions of a block of texts at once.
2. Around a seed, shared q-grams are counted in the diagonal bands that hold it: bands are 2 (e + 1) diagonals wide
   and begin every e + 1, so that a match with e edits lies in one of them. By the q-gram lemma a match shares
   L - q + 1 - q e q-grams at least; bands with fewer are dropped.
3. What is left is aligned: edit distance of the whole item to the best stretch of the band's part of the document.

Items are sent to the executors in blocks of at most `BLOCK_CHARS` characters, as many as the table needs; each block
of items meets all documents (a stated query set against all rows).

Defined results: null or empty texts and items match nothing; texts are never cut; items of equal text are found
each; where stretches of one item overlap, the one with the fewest edits and then the first stays; repeated rows
are searched each; empty tables give no matches; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.tables import pieces

#: Edits allowed, as a share of the item's characters.
EDITS = 0.08
Q = 6
BLOCK_CHARS = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` characters."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power = None, 0, 1
    step, covered, scale, left = codes + np.uint64(1), 1, int(_BASE), length
    while left:  # by doubling: hashes of 1, 2, 4, ... characters, those of the length's binary digits put together
        if left & 1:
            part = step[done : done + n]
            out = part.copy() if out is None else out + part * np.uint64(power)
            power, done = power * scale % (1 << 64), done + covered
        left >>= 1
        if left:
            step = step[:-covered] + step[covered:] * np.uint64(scale)
            covered, scale = 2 * covered, scale * scale % (1 << 64)
    return (out ^ (out >> np.uint64(29))) * _BASE


def _distances(item: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Edits of the whole item to the best part of the stretch that ends at each position."""
    row = np.zeros(len(stretch) + 1, np.int64)
    steps = np.arange(len(stretch) + 1)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (stretch != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Edits, start and end of the part of the stretch nearest to the item; the first of equals, the shortest."""
    ends = _distances(item, stretch)
    end = int(np.argmin(ends))
    starts = _distances(item[::-1], stretch[:end][::-1])
    return int(ends[end]), end - int(np.argmin(starts)), end


class Items:
    """A block of benchmark items, prepared for the search."""

    def __init__(self, rows: list[tuple[int, str | None]], edits: float = EDITS, q: int = Q):
        self.rows = [(i, _codes(t)) for i, raw in rows if (t := plain(raw))]
        self.edits, self.q = edits, q

    def __getstate__(self) -> tuple:
        return self.rows, self.edits, self.q

    def __setstate__(self, state: tuple) -> None:
        self.rows, self.edits, self.q = state

    @cached_property
    def budgets(self) -> list[int]:
        return [math.floor(len(codes) * self.edits) for _, codes in self.rows]

    @cached_property
    def seeds(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of seeds: length, a table of bits, sorted hashes, and item and place of each."""
        found: dict[int, list] = defaultdict(list)
        shortest = {}
        for n, (_, codes) in enumerate(self.rows):
            shortest[n] = len(codes) // (self.budgets[n] + 1)
        for n, (_, codes) in enumerate(self.rows):
            length = min(12, shortest[n])
            # one length for all long items, so that texts are hashed once or twice
            length = 8 if 8 <= length < 11 else min(length, 11)
            hashes = rolling(codes, length)
            for k in range(self.budgets[n] + 1):
                found[length].append((hashes[k * shortest[n]], n, k * shortest[n]))
        out = []
        for length, rows in sorted(found.items()):
            hashes = np.array([x[0] for x in rows], np.uint64)
            by = np.argsort(hashes, kind="stable")
            marked = np.zeros(1 << _BITS, bool)
            marked[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            out.append((length, marked, hashes[by], np.array([x[1] for x in rows])[by], np.array([x[2] for x in rows])[by]))
        return out

    @cached_property
    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted q-gram hashes of each item and their places."""
        out = []
        for _, codes in self.rows:
            hashes = rolling(codes, self.q)
            by = np.argsort(hashes, kind="stable")
            out.append((hashes[by], by))
        return out

    def _bands(self, codes: np.ndarray, owner: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, band) of every band that holds a seed; places of the joint array of characters."""
        out: set[tuple[int, int, int]] = set()
        for length, marked, hashes, items, places in self.seeds:
            all_hashes = rolling(codes, length)
            near = np.flatnonzero(marked[(all_hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
            wanted = all_hashes[near]
            low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
            for at, a, b in zip(near[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                for k in range(a, b):
                    item = int(items[k])
                    diagonal, step = at - int(places[k]), self.budgets[item] + 1
                    text = int(owner[at])
                    out |= {(text, item, diagonal // step), (text, item, diagonal // step - 1)}
        return out

    def _shared(self, item: int, hashes: np.ndarray, offset: int, first: int, last: int) -> int:
        """Places of the item whose q-gram stands in the text on a diagonal from first to last."""
        own, places = self.grams[item]
        low, high = np.searchsorted(own, hashes, "left"), np.searchsorted(own, hashes, "right")
        hit = np.flatnonzero(low < high)
        count = (high - low)[hit]
        at = np.repeat(hit, count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = places[np.repeat(low[hit], count) + inner]
        diagonal = at + offset - place
        return len(np.unique(place[(diagonal >= first) & (diagonal <= last)]))

    def find(self, texts: list[str]) -> list[list[dict]]:
        """For each text (as `plain` gives it) the stretches near an item."""
        joined = "\0".join(texts)
        codes, lengths = _codes(joined), np.array([len(x) for x in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts)]
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        found: list[dict[int, list[tuple[int, int, int]]]] = [defaultdict(list) for _ in texts]
        for text, item, band in sorted(self._bands(codes, owner)) if len(self.rows) else ():
            own, edits = self.rows[item][1], self.budgets[item]
            first, last = band * (edits + 1), (band + 2) * (edits + 1) - 1
            begin, end = int(begins[text]), int(begins[text] + lengths[text])
            low, high = max(begin, first), min(end, last + len(own) + edits)
            if low >= high:
                continue
            least = len(own) - self.q + 1 - self.q * edits
            if least > 0 and self._shared(item, rolling(codes[low:high], self.q), low, first, last) < least:
                continue
            cost, a, b = align(own, codes[low:high])
            if cost <= edits:
                found[text][item].append((cost, low + a - begin, low + b - begin))
        return [[r for item, got in sorted(x.items()) for r in self._best(item, got)] for x in found]

    def _best(self, item: int, got: list[tuple[int, int, int]]) -> list[dict]:
        kept: list[tuple[int, int, int]] = []
        for cost, a, b in sorted(set(got)):
            if all(b <= c or a >= d for _, c, d in kept):
                kept.append((cost, a, b))
        return [{"item_id": self.rows[item][0], "start": a, "end": b, "edits": c} for c, a, b in sorted(kept, key=lambda x: x[1])]


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The items in blocks of about block_chars characters, one at a time on the driver."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_chars))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Items([tuple(r) for r in part.toLocalIterator()])


KIND = "array<struct<item_id: bigint, start: bigint, end: bigint, edits: bigint>>"


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", matches: str = "matches", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with an array of matches: item_id, start and end in the compared text, edits."""
    out = docs.drop(matches).withColumn(matches, F.lit(None).cast(KIND))
    for items in blocks_of(benchmark, block_chars):
        out = _searched(out, items, text, matches)
    return out


def _searched(docs: DataFrame, items: Items, text: str, matches: str) -> DataFrame:
    shared, names = docs.sparkSession.sparkContext.broadcast(items), docs.columns
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "start", "end", "edits")]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text, 1 << 20):
                found = shared.value.find([plain(x) for x in batch.column(text).to_pylist()])
                before = batch.column(matches).to_pylist()
                new = pa.array([(a or []) + b for a, b in zip(before, found, strict=True)], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c != matches), new], names)

    return docs.mapInArrow(each, docs.schema)


def clean(matches: str = "matches") -> Column:
    """True for rows of with_matches that hold no item."""
    return F.size(matches) == 0


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per match: doc_id, item_id, start, end, edits."""
    found = with_matches(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.start", "m.end", "m.edits")
