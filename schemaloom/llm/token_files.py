"""Token-id files: raw id payloads in document order, each shard with a minimal perfect hash index of its documents.

Format. A shard is one row of a Parquet folder (Spark's writers reach every store that executors share; plain files
do not), of about `SHARD_IDS` ids; a document is never split, so that a very long one has a shard of its own:

| column | content |
| --- | --- |
| part, part_start | first doc_id of the range the shard lies in; ids of that range before this shard |
| first_id, last_id, n_ids | smallest and largest doc_id, ids in the shard |
| doc_ids, ends | documents in order (null first), and where their ids end, counted in ids |
| width, payload | bytes per id (2 or 4), the ids as little-endian unsigned integers |
| level_sizes, level_bits | the perfect hash of the distinct doc_ids that are not null |
| fingerprints, rows | for each slot 16 bits of the key's hash, and the row of its first document |

Documents are dealt out by ranges of doc_id in one shuffle, encoded and packed by the same task. The number of ids
before a range comes from one row per range.

Defined results: a null or empty text has only the end id; null doc_ids come first and are found by scanning, not by
key; documents of equal doc_id follow each other in order of text, and a key leads to all of them; an empty table
gives no shards; extra columns are left alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.llm.perfect_hash import PerfectHash, mix
from schemaloom.llm.pretokens import TextEncoder, pack_ids
from schemaloom.session import new_folder

SHARD_IDS = 1 << 20
_SCHEMA = """part long, part_start long, first_id long, last_id long, n_ids long, doc_ids array<long>, ends array<long>,
width int, payload binary, level_sizes array<long>, level_bits binary, fingerprints binary, rows binary"""


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class LibraryEncoder(TextEncoder):
    """Encodes with the tokenizers library: each pre-token that a task has not met yet goes through the library's model.

    Byte-level pre-tokens are encoded one by one by the library, too, so that the ids are those of whole texts. A text
    that holds a string of an added token goes through the library as a whole; `encode_special_tokens` is the
    library's setting of that name: True makes the strings of special tokens ordinary text.
    """

    def __init__(self, content: str, pattern: str, encode_special_tokens: bool = True):
        told = json.loads(content)
        if told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without a normalizer or a prefix space")
        self.content, self.pattern, self.encode_special_tokens = content, pattern, encode_special_tokens

    def __getstate__(self) -> tuple:
        return self.content, self.pattern, self.encode_special_tokens

    def __setstate__(self, state: tuple) -> None:
        self.content, self.pattern, self.encode_special_tokens = state

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.content)
        made.encode_special_tokens = self.encode_special_tokens
        return made

    @cached_property
    def library(self):
        return self.whole.model

    @cached_property
    def added(self) -> list[str]:
        """The strings that the library takes out of a text before it splits the rest."""
        told = json.loads(self.content)["added_tokens"]
        return [x["content"] for x in told if not (x["special"] and self.encode_special_tokens)]

    def encode_text(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return pack_ids(self.whole.encode(text, add_special_tokens=False).ids)
        return super().encode_text(text)

    @cached_property
    def letters(self) -> dict[int, str]:
        return _byte_letters()

    def resolve(self, token: str) -> bytes:
        spelled = token.encode().decode("latin-1").translate(self.letters)
        return pack_ids([x.id for x in self.library.tokenize(spelled)])


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64), 77) >> np.uint64(48)).astype("<u2")


def _key_hash(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.int64).view(np.uint64)


def pack(part: int | None, part_start: int, ids: list[int | None], texts: list[np.ndarray], width: int) -> dict:
    """One shard from documents in order."""
    counts = np.array([len(x) for x in texts], np.int64)
    named = [i for i, key in enumerate(ids) if key is not None]
    keys, first = np.unique(np.array([ids[i] for i in named], np.int64), return_index=True)
    table = PerfectHash.build(_key_hash(keys))
    slots = table.slots(_key_hash(keys))
    prints, rows = np.zeros(len(keys), "<u2"), np.zeros(len(keys), "<u4")
    prints[slots], rows[slots] = fingerprint(keys), np.array(named, np.int64)[first] if len(keys) else first
    return {
        "part": part,
        "part_start": part_start,
        "first_id": int(keys[0]) if len(keys) else None,
        "last_id": int(keys[-1]) if len(keys) else None,
        "n_ids": int(counts.sum()),
        "doc_ids": ids,
        "ends": np.cumsum(counts).tolist(),
        "width": width,
        "payload": np.concatenate(texts).astype(f"<u{width}").tobytes() if texts else b"",
        "level_sizes": table.sizes,
        "level_bits": np.packbits(table.bits).tobytes(),
        "fingerprints": prints.tobytes(),
        "rows": rows.tobytes(),
    }


class Shard:
    """A row of the format, for reading."""

    def __init__(self, row: dict):
        self.row, self.ids, self.ends = row, row["doc_ids"], row["ends"]
        sizes = row["level_sizes"]
        bits = np.unpackbits(np.frombuffer(row["level_bits"], np.uint8), count=sum(sizes)).astype(bool)
        self.table = PerfectHash.from_bits(sizes, bits)
        self.prints, self.rows = np.frombuffer(row["fingerprints"], "<u2"), np.frombuffer(row["rows"], "<u4")
        self.payload = np.frombuffer(row["payload"], f"<u{row['width']}")

    def ids_of(self, at: int) -> np.ndarray:
        return self.payload[self.ends[at - 1] if at else 0 : self.ends[at]]

    def find(self, keys: np.ndarray) -> list[list[int]]:
        """Rows of each key: the slot, its fingerprint, then the stored key; none for a strange key."""
        slots, prints = self.table.slots(_key_hash(keys)), fingerprint(keys)
        found: list[list[int]] = []
        for key, slot, mark in zip(keys.tolist(), slots.tolist(), prints.tolist(), strict=True):
            rows: list[int] = []
            if slot >= 0 and self.prints[slot] == mark:
                at = int(self.rows[slot])
                while at < len(self.ids) and self.ids[at] == key:
                    rows.append(at)
                    at += 1
            found.append(rows)
        return found


def write(docs: DataFrame, model: LibraryEncoder, path: str, end_id: int = 0, width: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encodes docs (doc_id, text), adds the end id to each, and writes the shards below path.

    An id takes `width` bytes, by default as many as the vocabulary needs; an id that does not fit is an error.
    """
    largest = max(end_id, *model.whole.get_vocab(with_added_tokens=True).values())
    width = width or (2 if largest < 1 << 16 else 4)
    spark = docs.sparkSession
    shared, n = spark.sparkContext.broadcast(model), int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = pack_ids([end_id])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, total = None, 0, 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        begun = False

        def flush() -> pa.RecordBatch:
            row = pack(part, start, ids, held, width)
            return pa.RecordBatch.from_pylist([row], schema=_arrow())

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, begun = (part, True) if begun else (key, True)
                got = np.frombuffer(shared.value.encode_text(text.as_py() or "") + end, "<u4")
                if int(got.max()) >> (8 * width):
                    raise ValueError(f"id {int(got.max())} does not fit into {width} bytes")
                if ids and total + len(got) > shard_ids:
                    yield flush()
                    start, total, ids, held = start + total, 0, [], []
                ids.append(key)
                held.append(got.astype(f"<u{width}"))
                total += len(got)
        if ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(each, _SCHEMA).write.parquet(path)


def _arrow() -> pa.Schema:
    long, longs, data = pa.int64(), pa.list_(pa.int64()), pa.binary()
    kinds = {"doc_ids": longs, "ends": longs, "level_sizes": longs, "width": pa.int32()}
    kinds |= dict.fromkeys(("payload", "level_bits", "fingerprints", "rows"), data)
    names = [x.split()[0] for x in _SCHEMA.replace("\n", " ").split(", ")]
    return pa.schema([(x, kinds.get(x, long)) for x in names])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard(batch.slice(i, 1).to_pylist()[0])


def summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files.

    Every document that has a key is read by its key.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            keys = np.array(sorted({x for x in shard.ids if x is not None}), np.int64)
            order = [i for i, x in enumerate(shard.ids) if x is None] + [i for rows in shard.find(keys) for i in rows]
            got = [shard.ids_of(i).astype("<u4") for i in order]
            starts = [shard.ends[i - 1] if i else 0 for i in order]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([shard.row["part"]] * len(order), pa.int64()),
                    "doc_id": pa.array([shard.ids[i] for i in order], pa.int64()),
                    "at": pa.array([shard.row["part_start"] + x for x in starts], pa.int64()),
                    "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64()),
                }
            )

    shards = spark.read.schema(_SCHEMA).parquet(path)
    before = W.orderBy(F.col("part").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per range
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    docs = shards.mapInArrow(each, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    joined = docs.join(parts, F.col("part").eqNullSafe(F.col("p")))
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of some documents: only shards whose range holds a key are read."""
    wanted = np.array(sorted(set(keys)), np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            rows = [i for found in shard.find(wanted) for i in found]
            out = {"doc_id": [shard.ids[i] for i in rows], "ids": [shard.ids_of(i).astype("<u4").tobytes() for i in rows]}
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, ids binary")
    shards = spark.read.schema(_SCHEMA).parquet(path)
    ends = (F.col("last_id") >= int(wanted[0])) & (F.col("first_id") <= int(wanted[-1]))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards in whose range a key lies, however many keys there are."""
        for batch in batches:
            first, last = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first_id", "last_id"))
            there = np.searchsorted(wanted, first, "left") < np.searchsorted(wanted, last, "right")
            yield batch.filter(pa.array(there, pa.bool_())).select(["p", "s"])

    # ranges first, from their columns alone; only then payloads
    ranges = shards.where(ends).select(F.col("part").alias("p"), F.col("part_start").alias("s"), "first_id", "last_id")
    named = ranges.mapInArrow(holding, "p long, s long")
    same = F.col("part").eqNullSafe(F.col("p")) & (F.col("part_start") == F.col("s"))
    held = shards.where(ends).join(named, same, "left_semi")
    return held.select(*(x.name for x in shards.schema)).mapInArrow(each, "doc_id long, ids binary")


def round_trip(docs: DataFrame, model: LibraryEncoder) -> DataFrame:
    """Writes the files to a new shared folder and summarises what they hold."""
    path = new_folder(docs.sparkSession)
    write(docs, model, path)
    return summary(docs.sparkSession, path)
