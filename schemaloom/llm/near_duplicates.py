"""Near-duplicate documents: HyperMinHash registers, bands, estimate, check on full sets, components.

1. Every text gives its shingle set, the set's id and registers. Texts of equal sets are one class from here on, so
   that exact copies, however many, are one row.
2. Classes that share a band form a bucket. Each class is paired with two classes of its bucket, the least and the
   greatest id: two pairs per class and bucket, whatever the bucket's size. Pairs whose estimated similarity is too
   low go, the others are checked on their full sets, and components of the links are found.
3. A link may join classes of which neither leads a bucket. So buckets that still hold more than one component are
   gone through once more, first by registers: a task estimates pairs of different components, each in the first band
   they share, marks classes that may have a partner, and chains their components. Only marked classes go on: their full sets
   go once to their chain and are checked there until components meet; only such links leave the task, at most one less
   than classes. Large buckets are dealt out by pairs of blocks of `BLOCK` classes, large chains by `BLOCK_BYTES`.

So no link between different sets is lost but those that share no band (hyperminhash.ROWS), and pairs are never
written out group by group.

Defined results: a text without words has no set and is linked with nothing; a null doc_id takes part, its component
has the smallest id of the others, or none; texts are taken whole, and of very long ones a task holds one set at a time or
a block of `BLOCK_BYTES`; rows that repeat a doc_id share its component if their texts do; a row is
kept if its doc_id is the component's (or if the component has no id); an empty table gives an empty result; extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm import hyperminhash as hmh
from schemaloom.llm.tables import pieces
from schemaloom.session import cut

#: Classes of a bucket whose registers one task compares with each other or with those of as many others.
BLOCK = 2048
#: Bytes of full sets, about, that one task compares with each other or with as many others.
BLOCK_BYTES = 32 << 20
#: Tasks over which the rows of one key are dealt.
SALTS = 8
#: A bitmap of rows has at most 2^27 bits: 16 MB.
MARK_BITS, _PAGE_BITS = 27, 15


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t (digest of the text), n (shingles), v (id of the set) and regs for each row; the last two null if n = 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                sets = [hmh.shingles(x or "", size) for x in batch.column("text").to_pylist()]
                full = [i for i, x in enumerate(sets) if len(x)]
                rows = hmh.bands(hmh.registers([sets[i] for i in full])) if full else np.zeros((0, hmh.BANDS), "<i8")
                ids: list = [None] * len(sets)
                regs: list = [None] * len(sets)
                for i, row in zip(full, rows, strict=True):
                    ids[i], regs[i] = hmh.set_id(sets[i]), row
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "t": batch.column("t"),
                        "n": pa.array([len(x) for x in sets], pa.int64()),
                        "v": pa.array(ids, pa.int64()),
                        "regs": pa.array(regs, pa.list_(pa.int64())),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(each, "doc_id long, t long, n long, v long, regs array<long>")


class Marks:
    """A bounded bitmap of row keys: rows whose bit is not set surely have none of the keys.

    It only saves a shuffle of texts that an exact join would drop anyway. With more keys than it has room for, more
    rows go to that join.
    """

    def __init__(self, keys: DataFrame, most: int):
        self.bits = min(most, max(_PAGE_BITS, (16 * max(1, keys.count())).bit_length()))
        at = self._at(F.col("doc_id"), F.col("t"))
        rows = keys.select(self._page(at).alias("__page"), (at % (1 << _PAGE_BITS)).alias("bit"))
        self.pages = cut(rows.groupBy("__page").agg(F.bitmap_construct_agg("bit").alias("__bits")))

    def _at(self, doc_id: Column, digest: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id, digest), F.lit(1 << self.bits))

    @staticmethod
    def _page(at: Column) -> Column:
        return F.shiftright(at, _PAGE_BITS)

    def rows(self, docs: DataFrame, wanted: bool) -> DataFrame:
        """The rows of docs whose bit is set, or those whose bit is not."""
        at = self._at(F.col("doc_id").cast("long"), F.xxhash64("text"))
        placed = docs.withColumns({"__page": self._page(at), "__bit": at % (1 << _PAGE_BITS)})
        beside = placed.join(F.broadcast(self.pages), "__page", "left")  # 2^most bits at most
        byte = F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, 1)
        held = F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("__bit") % 8).cast("int")) == 1
        return beside.where(F.coalesce(held, F.lit(False)) == wanted).select(*docs.columns)


def full_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """v, n, shingles (sorted 64-bit hashes) of classes (v, doc_id, t), from one text of each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                sets = [hmh.shingles(x or "", size) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "v": pa.array([hmh.set_id(x) for x in sets], pa.int64()),
                        "n": pa.array([len(x) for x in sets], pa.int64()),
                        "shingles": pa.array([x.tobytes() for x in sets], pa.binary()),
                    }
                )

    wanted = cut(classes.select("doc_id", "t"))
    docs = Marks(wanted, MARK_BITS).rows(docs.select("doc_id", "text"), wanted=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("tt"), "text")
    rows = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("tt") == F.col("t")), "left_semi")
    sets = rows.dropDuplicates(["d", "tt"]).select("text").mapInArrow(each, "v long, n long, shingles binary")
    return sets.dropDuplicates(["v"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(column), width)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and registers don't rule out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), hmh.BANDS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array(_likely(a, b, na, nb, percent)))

    for side in ("a", "b"):
        own = classes.select(F.col("v").alias(side), F.col("n").alias(f"n{side}"), F.col("regs").alias(f"r{side}"))
        pairs = pairs.join(own, side)
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.where(sizes).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(each, "a long, b long")


def _likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    near = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return near & (hmh.similarity(a, b) >= hmh.least_estimate(percent, np.maximum(na, nb)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are linked."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("sa"), batch.column("sb"), strict=True)
            true = [hmh.linked(*(np.frombuffer(x.as_buffer(), "<u8") for x in row), percent) for row in rows]
            yield batch.select(["a", "b"]).filter(pa.array(true, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("v").alias(side), F.col("shingles").alias(f"s{side}")), side)
    return pairs.select("a", "b", "sa", "sb").mapInArrow(each, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """v, comp for every vertex of edges (a, b) that is not the smallest of its component; comp is the smallest.

    Alternates between linking larger neighbours and smaller ones to the smallest neighbour, until nothing changes.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now, before = cut(edges.select(a, b).where("a != b").distinct()), None
    for _ in range(most):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("v"), F.col("b").alias("comp"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _lookup(both.where("b > a"), "a", least, F.col("b"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, before = cut(small.unionByName(least.withColumnRenamed("m", "b")).distinct()), mark
    raise RuntimeError(f"components didn't settle in {most} rounds")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, end in pairwise(ends):
            key = tuple(keys[start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _blocks(group: pa.Table) -> tuple[np.ndarray, bool]:
    """The block of each row, and whether only rows of different blocks are compared here."""
    return group.column("side").to_numpy(), group.column("x")[0] != group.column("y")[0]


def _partners(group: pa.Table, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Rows that may have a partner in another component of a bucket, and pairs that chain the components of such rows."""
    regs = _matrix(group.column("regs").combine_chunks(), hmh.BANDS)
    n, comp = (group.column(c).to_numpy() for c in ("n", "comp"))
    (side, crossing), band = _blocks(group), group.column("band")[0].as_py()
    chain, marked, out = comp.copy(), np.zeros(len(comp), bool), []
    for i in range(len(comp) - 1):
        rest = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
        if crossing:
            rest = rest[side[rest] != side[i]]
        same = regs[rest] == regs[i]
        rest = rest[same.any(axis=1) & (same.argmax(axis=1) == band)]
        rest = rest[_likely(regs[rest], regs[i][None], n[rest], n[i], percent)]
        if len(rest):
            marked[i] = marked[rest] = True
            others, first = np.unique(chain[rest], return_index=True)
            new = others != chain[i]
            if new.any():
                out += [(int(comp[i]), int(c)) for c in comp[rest[first[new]]]]
                chain[np.isin(chain, others[new])] = chain[i]
    return marked, out


def _meet(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between components, found on full sets; rows of two blocks are compared crosswise only."""
    regs = _matrix(group.column("regs").combine_chunks(), hmh.BANDS)
    n, comp = (group.column(c).to_numpy() for c in ("n", "comp"))
    (side, crossing), comp = _blocks(group), comp.copy()
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("shingles")]
    out = []
    for i in range(len(comp) - 1):
        rest = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])  # components that have met have one name
        if crossing:
            rest = rest[side[rest] != side[i]]
        rest = rest[(regs[rest] == regs[i]).any(axis=1)]
        rest = rest[_likely(regs[rest], regs[i][None], n[rest], n[i], percent)]
        for k in rest.tolist():
            if comp[k] != comp[i] and hmh.linked(sets[i], sets[k], percent):
                out.append((int(comp[i]), int(comp[k])))
                comp[comp == comp[k]] = comp[i]
    return out


def _dealt(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows once for each pair (x, y) of blocks of their key that their own block (side) is part of, key by key."""
    own = F.pmod(F.xxhash64("v", F.lit(3)), blocks).cast("long")
    rows = rows.withColumns({"side": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    rows = rows.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")}).drop("other")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key, "x", "y").sortWithinPartitions(key, "x", "y")


def meeting(buckets: DataFrame, sets: DataFrame, percent: int, block: int, block_bytes: int) -> DataFrame:
    """Links (a, b) between components of buckets: key, band, members, v, comp, n, regs.

    Registers alone go to the buckets. Only classes that may have a partner in another component go on, with their
    full sets, and these go once to the chain of components that they are part of, however many buckets they share.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "x", "y"]):
            marked, chains = _partners(group, percent)
            if marked.any():
                v, comp = (group.column(c).to_numpy()[marked] for c in ("v", "comp"))
                none = [None] * len(v)
                a, b = [*none, *(p for p, _ in chains)], [*none, *(q for _, q in chains)]
                rest = [None] * len(chains)
                columns = ([*v.tolist(), *rest], [*comp.tolist(), *rest], a, b)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["v", "comp", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["chain", "x", "y"]):
            if found := _meet(group, percent):
                yield pa.RecordBatch.from_pydict({"a": [p for p, _ in found], "b": [q for _, q in found]})

    dealt = _dealt(buckets, "key", F.ceil(F.col("members") / block))
    marks = cut(dealt.select("key", "x", "y", "side", "band", "v", "comp", "n", "regs").mapInArrow(mark, "v long, comp long, a long, b long"))
    chains = components(marks.where("a is not null").select("a", "b")).select(F.col("v").alias("comp"), F.col("comp").alias("chain"))
    kept = marks.where("v is not null").select("v", "comp").distinct().join(chains, "comp", "left")
    kept = kept.withColumn("chain", F.coalesce("chain", "comp"))
    kept = cut(kept.join(buckets.select("v", "n", "regs").dropDuplicates(["v"]), "v"))
    sizes = kept.groupBy("chain").agg(F.ceil(F.sum(8 * F.col("n") + 8 * hmh.BANDS) / block_bytes).alias("blocks"))
    full = kept.join(sizes, "chain").join(sets.select("v", "shingles"), "v")
    dealt = _dealt(full, "chain", F.col("blocks"))
    return dealt.select("chain", "x", "y", "side", "comp", "n", "regs", "shingles").mapInArrow(meet, "a long, b long")


def _lookup(rows: DataFrame, key: str, table: DataFrame, salt: Column) -> DataFrame:
    """rows with the row of `table` of their key, if there is one; rows of a very common key go to several tasks."""
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return rows.join(table, [key, "_salt"], "left").drop("_salt")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Besides, t (digest of the text) and root (the component, null without words), to find rows without an id by.
    """
    rows = cut(signatures(docs, size))
    classes = cut(rows.where("n > 0").dropDuplicates(["v"]))
    keyed = classes.select("v", F.posexplode("regs").alias("band", "reg"))
    keyed = keyed.select("v", "band", F.xxhash64("band", "reg").alias("key"))
    ends = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("v").alias("low"), F.max("v").alias("high"))
    buckets = cut(keyed.join(ends.where("members > 1"), "key"))

    stars = buckets.select("v", F.explode(F.array("low", "high")).alias("w")).where("v != w")
    stars = stars.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    likely = cut(estimated(stars, classes, percent))
    in_buckets = buckets.select("v").distinct()
    sets = cut(full_sets(docs, classes.join(in_buckets, "v", "left_semi"), size))
    first = components(verified(likely, sets, percent))

    label = first.select(F.col("v").alias("w"), "comp")
    members = buckets.select("key", "band", "members", "v").join(label, F.col("v") == F.col("w"), "left")
    members = cut(members.withColumn("comp", F.coalesce("comp", "v")).drop("w"))
    mixed = members.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p != q").select("key")
    open_ = cut(members.join(mixed, "key").join(classes.select("v", "n", "regs"), "v"))
    met = components(meeting(open_, sets, percent, block, block_bytes))
    second = met.select(F.col("v").alias("comp"), F.col("comp").alias("root"))

    final = first.join(second, "comp", "left").select("v", F.coalesce("root", "comp").alias("root"))
    alone = second.join(first.select(F.col("v").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("v"), "root")
    labels = cut(final.unionByName(alone))
    # the smallest doc_id of each class, then of each component of several classes
    per_class = rows.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("copies"))
    per_class = cut(per_class.join(labels, "v", "left").withColumn("root", F.coalesce("root", "v")))
    linked = labels.select("root").distinct().join(per_class, "root")
    per_root = linked.groupBy("root").agg(F.min("own").alias("least"), F.lit(True).alias("several"))
    found = _lookup(per_class, "root", per_root, F.col("v"))
    found = found.where("copies > 1 or several").select("v", "root", F.coalesce("least", "own").alias("least"))
    labelled = _lookup(rows.select("doc_id", "t", "n", "v"), "v", found, F.struct("doc_id", "t"))
    least = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    out = labelled.select("doc_id", F.col("n").alias("n_shingles"), least, "t", F.coalesce("root", "v").alias("root"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one of each component does: that with the smallest doc_id.

    Texts without words all stay. Of rows that repeat the smallest doc_id, or of a component without any, one stays.
    """
    judged = cut(near_duplicates(docs, size, percent).select("doc_id", "t", "root", "kept"))
    stay = judged.where("kept and root is not null")
    several = stay.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    several = cut(stay.join(several, "root", "left_semi").select("doc_id", "t", "root").distinct())
    gone = judged.where("not kept").select("doc_id", "t").unionByName(several.select("doc_id", "t")).distinct()
    gone = cut(gone)
    marks = Marks(gone, MARK_BITS)
    out = marks.rows(docs, wanted=False).unionByName(marks.rows(docs, wanted=True).join(_named(gone), _same_row(), "left_anti"))
    if several.isEmpty():
        return out
    again = docs.join(_named(several), _same_row()).dropDuplicates(["__root"]).select(*docs.columns)
    return out.unionByName(again)


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"__{c}") for c in rows.columns))


def _same_row() -> Column:
    return F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text").eqNullSafe(F.col("__t")))
