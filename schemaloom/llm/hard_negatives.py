"""Hard negatives: for anchors and their nearest rows of the same label, the best rows of other labels in a score window.

1. Space is cut into at most `CELLS` cells around centres taken farthest first from a bounded sample (`SAMPLE` rows);
   every row goes to the cell of its nearest centre. A cell with many rows is dealt out to parts, and each part
   becomes one cover tree (`cover_tree`), stored as a row of the index. The sample decides only where cells lie.
2. Queries visit the most promising cell first; with what they have found they then visit those other cells whose
   bounds still reach into one of their windows. Within a part the tree is descended best first. Leaves are verified
   with exact integer products, so the result equals that of comparing everything.
3. Positives are searched with one open window, negatives with one window for each positive.

In a task there are one tree and a batch of queries. A part that has many queries is dealt out again by them.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; vectors are
filled up with zeros to the longest (an empty vector is zero); rows that repeat an id are rows like others, and each
of them is an anchor; a null id comes after all others in ties; scores tie by the smaller id; an anchor without rows of its label,
or a positive without rows in its window, has no result (a negative positive_score has an empty window); an empty
table gives an empty result; other columns are left out. Sums of squares of 2^53 or more, where products would not be
exact, are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.llm.cover_tree import NONE, CoverTree, Windows, augmented, bounds, farthest_first
from schemaloom.session import cut

CELLS = 1024
SAMPLE = 4096
#: Bytes of the vectors of one tree, as doubles.
PART_BYTES = 8 << 20
#: Queries that one copy of a tree answers, about.
SLICE = 1024
_FOUND = "uid long, w int, score double, id long"


def finite(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return pairwise(ends)


class Index:
    """Cells, and cover trees over all rows (vec_id, label, vector) as a stored table."""

    def __init__(self, rows: DataFrame):
        named = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(NONE))).alias("id"), F.col("label").cast("long"), "vector")
        named = named.where(F.col("label").isNotNull() & finite(F.col("vector")))
        named = cut(named.select(F.monotonically_increasing_id().alias("uid"), "id", "label", F.col("vector").cast("array<double>")))
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        facts = named.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(square).alias("most")).first()
        self.n, self.width, self.most = facts["n"], max(1, facts["width"] or 1), float(np.sqrt(facts["most"] or 0.0)) or 1.0
        if (facts["most"] or 0) >= 2.0**53:
            raise ValueError("vectors are too long for exact integer products: a sum of squares is 2^53 or more")
        self.part_rows = max(256, PART_BYTES // (8 * self.width))
        self._centre(named)
        self._plant(named)

    def _centre(self, named: DataFrame) -> None:
        sample = named.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        points = augmented(_matrix(sample, self.width), self.most) if self.n else np.zeros((1, self.width + 1))
        wanted = min(CELLS, -(-self.n // self.part_rows))
        self.centres = points[farthest_first(points, 0, max(1, wanted), np.inf)[0]]

    def _plant(self, named: DataFrame) -> None:
        centres, most, width, part_rows = self.centres, self.most, self.width, self.part_rows

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                products = augmented(_matrix(batch.column("vector"), width), most) @ centres.T
                cell = products.argmax(axis=1)
                cos = np.take_along_axis(products, cell[:, None], 1)[:, 0] / (most * most)
                arrays = [*batch.columns, pa.array(cell, pa.int32()), pa.array(cos)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cell", "cos"])

        schema = "uid long, id long, label long, vector array<double>, cell int, cos double"
        self.rows = cut(named.mapInArrow(assign, schema))
        facts = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("cos"), F.min("id").alias("least"))
        cells = facts.orderBy("cell").collect()  # at most CELLS rows
        self.cells = {
            "cell": np.array([c["cell"] for c in cells], np.int64),
            "cos": np.clip(np.array([c["cos"] for c in cells], float), -1, 1),
            "least": np.array([c["least"] for c in cells], np.int64),
        }
        sizes, first = {}, 0
        for c in cells:
            sizes[c["cell"]] = (first, -(-c["n"] // part_rows))
            first += sizes[c["cell"]][1]
        self.parts, self.sizes = first, sizes
        places = self._places(self.rows.sparkSession)
        part = (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("pieces"))).alias("part")
        dealt = self.rows.join(F.broadcast(places), "cell").select("uid", "id", "label", "vector", "cell", part)
        dealt = dealt.repartition(self._tasks(), "part").sortWithinPartitions("part", "uid")

        def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                for a, b in _runs(batch.column("part").to_numpy()):
                    if held and held[0].column("part")[0] != batch.column("part")[a]:
                        yield tree(held)
                        held = []
                    held.append(batch.slice(a, b - a))
            if held:
                yield tree(held)

        def tree(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = _matrix(table.column("vector").chunk(0), width)
            made = CoverTree.build(vectors, *(table.column(c).to_numpy() for c in ("uid", "id", "label")))
            return pa.RecordBatch.from_pydict(
                {"cell": table.column("cell")[:1].combine_chunks(), "part": table.column("part")[:1].combine_chunks(), "tree": [made.packed()]}
            )

        self.trees = cut(dealt.mapInArrow(plant, "cell int, part long, tree binary"))

    def _places(self, spark) -> DataFrame:
        rows = [(c, first, pieces) for c, (first, pieces) in self.sizes.items()]
        return spark.createDataFrame(rows, "cell int, first long, pieces long")

    def _tasks(self) -> int:
        return max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.parts)

    def visits(self, queries: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
        """cell, batch (queries as bytes), number: which cells they have to visit; first (home) or after that."""
        centres, cells, most, width = self.centres, self.cells, self.most, self.width

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, wanted = _matrix(batch.column("vector"), width), [[] for _ in cells["cell"]]
                products = vectors @ centres[cells["cell"], :-1].T
                for i, windows in enumerate(_windows(batch, vectors, same, k)):
                    ub, lb = bounds(products[i], cells["cos"], windows.norm * most)
                    best = int(windows.reach(ub).argmax())
                    if home:
                        wanted[best].append(i)
                        continue
                    gains = windows.gains(ub, lb, cells["least"])
                    gains[best] = False
                    for c in np.flatnonzero(gains):
                        wanted[c].append(i)
                for c, own in enumerate(wanted):
                    if own:
                        yield pa.RecordBatch.from_pydict(
                            {
                                "cell": pa.array([cells["cell"][c]], pa.int32()),
                                "number": pa.array([len(own)], pa.int64()),
                                "batch": pa.array([_packed(batch.take(pa.array(own)))], pa.binary()),
                            }
                        )

        return queries.mapInArrow(each, "cell int, number long, batch binary")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """uid, w, score, id: the k best of each window w of queries (uid, label, vector, lo, hi)."""
        if not self.n:
            return self.rows.sparkSession.createDataFrame([], _FOUND)
        empty = F.expr(f"array_repeat(double('-Infinity'), size(lo) * {k})").alias("scores")
        none = F.expr(f"array_repeat({NONE}L, size(lo) * {k})").alias("ids")
        queries = queries.select("uid", "label", "vector", "lo", "hi")
        first = cut(self._answers(self.visits(queries.select("*", empty, none), same, k, home=True), same, k))
        # places of windows that are not full keep scores below all others
        each = F.struct("w", (-F.col("score")).alias("minus"), "id")
        filled = first.groupBy("uid").agg(F.array_sort(F.collect_list(each)).alias("found"))
        laid = "flatten(transform(sequence(0, size(lo) - 1), i -> slice(concat(transform(filter(found, x -> x.w = i), x -> {}), {}), 1, {})))"
        scores = laid.format("-x.minus", f"array_repeat(double('-Infinity'), {k})", k)
        ids = laid.format("x.id", f"array_repeat({NONE}L, {k})", k)
        kind = "array<struct<w:int,minus:double,id:bigint>>"
        known = queries.join(filled, "uid", "left").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {kind})")))
        known = known.select("uid", "label", "vector", "lo", "hi", F.expr(scores).alias("scores"), F.expr(ids).alias("ids"))
        more = self._answers(self.visits(known, same, k, home=False), same, k)
        return cut(_best(first.unionByName(more), k))

    def _answers(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """What trees add to the windows of the queries that visit them."""
        visits, width = cut(visits), self.width
        places = self._places(visits.sparkSession)
        busy = visits.groupBy("cell").agg(F.ceil(F.sum("number") / SLICE).alias("slices"))
        busy = F.broadcast(busy.join(F.broadcast(places), "cell"))  # at most CELLS rows
        asked = visits.join(busy, "cell").withColumn("slice", F.pmod(F.xxhash64("batch"), F.col("slices")))
        asked = asked.withColumn("part", F.explode(F.expr("sequence(first, first + pieces - 1)")))
        asked = asked.select("part", "slice", F.lit(1).alias("kind"), F.col("batch").alias("data"))
        trees = self.trees.join(busy.select("cell", "slices"), "cell")
        trees = trees.withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)")))
        trees = trees.select("part", "slice", F.lit(0).alias("kind"), F.col("tree").alias("data"))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for batch in batches:
                for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                    if kind == 0:  # comes before the queries of its part and slice
                        tree = CoverTree.unpacked(data.as_py())
                        continue
                    queries = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
                    yield from _descended(tree, queries, _matrix(queries.column("vector"), width), same, k)

        both = trees.unionByName(asked).repartition(self._tasks(), "part", "slice")
        both = both.sortWithinPartitions("part", "slice", "kind").select("kind", "data")
        return _best(both.mapInArrow(each, _FOUND), k)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _windows(batch: pa.RecordBatch, vectors: np.ndarray, same: bool, k: int) -> Iterator[Windows]:
    uids, labels = batch.column("uid").to_pylist(), batch.column("label").to_pylist()
    lists = [batch.column(c).to_pylist() for c in ("lo", "hi", "scores", "ids")]
    for uid, label, vector, lo, hi, scores, ids in zip(uids, labels, vectors, *lists, strict=True):
        yield Windows(vector, label, uid, same, k, lo, hi, scores, ids)


def _descended(tree: CoverTree, queries: pa.RecordBatch, vectors: np.ndarray, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    uids, ws, scores, ids = [], [], [], []
    for windows in _windows(queries, vectors, same, k):
        tree.descend(windows)
        w, place = np.nonzero(windows.new)
        uids.append(np.full(len(w), windows.uid))
        ws.append(w)
        scores.append(windows.scores[w, place])
        ids.append(windows.ids[w, place])
    columns = {"uid": (uids, np.int64), "w": (ws, np.int32), "score": (scores, np.float64), "id": (ids, np.int64)}
    yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(x).astype(t)) for c, (x, t) in columns.items()})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vector of whole numbers. `anchors` is a condition on vec_id (as `id`). Each anchor's positives
    are its best rows of the same label, and each positive's negatives the best rows of other labels whose score is
    between low and high per cent of the positive's.
    """
    index = Index(rows)
    chosen = index.rows.where(anchors).select("uid", "id", "label", "vector")
    open_ = chosen.withColumns({"lo": F.array(F.lit(float("-inf"))), "hi": F.array(F.lit(float("inf")))})
    best = index.search(open_, same=True, k=positives)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    best = best.select("uid", F.col("id").alias("positive_id"), F.col("score").cast("long").alias("p"), F.row_number().over(order).alias("at"))
    # whole numbers n with low * p <= 100 * n <= high * p; none if p is negative
    lo = F.expr(f"({low} * p + 99) div 100").cast("double").alias("lo")
    hi = F.expr(f"({high} * p) div 100").cast("double").alias("hi")
    best = cut(best.where(f"p >= 0 and {low} <= {high}").withColumn("w", F.row_number().over(Window.partitionBy("uid").orderBy("at")) - 1))
    ranges = best.select("uid", F.struct("w", lo, hi).alias("x"))
    ranges = ranges.groupBy("uid").agg(F.array_sort(F.collect_list("x")).alias("x"))
    windows = chosen.join(ranges, "uid").select("uid", "label", "vector", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    found = index.search(windows, same=False, k=negatives)
    rank = F.row_number().over(Window.partitionBy("uid", "w").orderBy(F.desc("score"), "id")).cast("int").alias("rank")
    found = found.select("uid", "w", rank, F.col("id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    known = lambda c: F.nullif(F.col(c), F.lit(int(NONE))).alias(c)
    out = found.join(best, ["uid", "w"]).join(chosen.select("uid", F.col("id").alias("anchor_id")), "uid")
    return out.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), F.col("p").alias("positive_score"), "negative_score")
