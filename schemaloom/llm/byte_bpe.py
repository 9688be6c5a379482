"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes.

First tier: pre-tokens that are in the vocabulary as they stand resolve to one id; a minimal perfect hash gives the
slot, the bytes stored there confirm it. Second tier: the bytes of a miss form a linked list, and a heap holds the
merges of neighbours by (rank, position); merges that have gone stale are skipped when they come up. A very long
pre-token takes n log n steps.

What a task remembers of pre-tokens it has met is bounded and only saves time (`pretokens`).

Defined results: null and empty texts have no ids; texts are never cut; repeated rows are encoded each; extra
columns are left alone.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.perfect_hash import PerfectHash
from schemaloom.llm.pretokens import TextEncoder, pack_ids
from schemaloom.llm.tables import pieces


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file on the driver."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging neighbours, the lowest rank first and the leftmost of equals."""
    n, rank_of = len(piece), ranks.get
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends, and so its neighbour begins; 0: merged
    begin = list(range(-1, n))  # begin[e]: where the part that ends at e begins
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue  # one of the two has been merged otherwise meanwhile
        end[j], end[i], begin[e] = 0, e, i
        if e < n and (rank := rank_of(piece[i : end[e]])) is not None:
            heapq.heappush(heap, (rank, i, end[e]))
        if i and (rank := rank_of(piece[begin[i] : e])) is not None:
            heapq.heappush(heap, (rank, begin[i], e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(TextEncoder):
    """Encodes and decodes with the ranks of one vocabulary; sent to executors as the ranks alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    def __getstate__(self) -> tuple:
        return self.ranks, self.pattern

    def __setstate__(self, state: tuple) -> None:
        self.ranks, self.pattern = state

    @cached_property
    def whole(self) -> tuple[PerfectHash, list[bytes], list[bytes]]:
        keys = list(self.ranks)
        table = PerfectHash.build(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
        slots = table.slots(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
        held: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, slots.tolist(), strict=True):
            held[slot] = key
        return table, held, [pack_ids([self.ranks[key]]) for key in held]

    def resolve(self, token: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        table, held, ids = self.whole
        piece = token.encode()
        slot = table.slot(xxhash.xxh3_64_intdigest(piece))
        if slot >= 0 and held[slot] == piece:
            return ids[slot]
        return pack_ids(merge(piece, self.ranks))

    @cached_property
    def spelled(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for key, rank in self.ranks.items():
            out[rank] = key
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def encode(df: DataFrame, model: Encoder, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds a binary column of ids, little-endian unsigned 32-bit integers."""
    return _mapped(df, model, text, [ids], lambda e, x: [_encoded(e, x)])


def decode(df: DataFrame, model: Encoder, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds a binary column of the bytes that ids stand for; null for null."""
    return _mapped(df, model, ids, [decoded], lambda e, x: [_decoded(e, x)])


def round_trip(df: DataFrame, model: Encoder, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """As `encode` and then `decode`, in one Python process a task instead of two, and without moving ids between them."""

    def both(e: Encoder, x: pa.Array) -> list[pa.Array]:
        made = _encoded(e, x)
        return [made, _decoded(e, made)]

    return _mapped(df, model, text, [ids, decoded], both)


def _encoded(model: Encoder, texts: pa.Array) -> pa.Array:
    return pa.array([model.encode_text(t.as_py() or "") for t in texts], pa.binary())


def _decoded(model: Encoder, ids: pa.Array) -> pa.Array:
    return pa.array([None if (i := x.as_py()) is None else model.decode(i) for x in ids], pa.binary())


def _mapped(df: DataFrame, model: Encoder, source: str, targets: list[str], work) -> DataFrame:
    shared, kept = df.sparkSession.sparkContext.broadcast(model), [c for c in df.columns if c not in targets]
    schema = df.select(*kept).schema
    for target in targets:
        schema = schema.add(target, "binary")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, source):
                new = work(shared.value, batch.column(source))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *targets])

    return df.select(*kept).mapInArrow(each, schema)


def digests(docs: DataFrame, model: Encoder) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes: encode, then decode, then hash."""
    return round_trip(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
