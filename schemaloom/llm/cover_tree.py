"""Cover tree for inner products: farthest-first levels with covering radii, best-first descent into score windows.

Vectors of one tree get one more component, so that all have the norm M of the longest: then the inner product with a
query is |q| M times the cosine of an angle, and angles obey the triangle inequality. A node is a vector with the
greatest angle to anything below it. Its children are chosen farthest first, itself included, until the radius has
halved or there are `FAN` of them, so that children lie at least a radius apart and cover their parent's vectors; a
node of at most `LEAF` vectors has these as its children. Every vector is exactly one node without children.

A descent keeps the best k of each window [lo, hi] by score, then smaller id. Nodes wait in the order of the highest
score they can add to some window; those that no window can gain from are dropped, and the best of the others are
opened: `FIRST` of them, then twice as many each time, up to `MOST`.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa

FAN = 64
LEAF = 128
FIRST, MOST = 8, 256
#: The id that stands in empty places of a window; sorts last.
NONE = np.iinfo(np.int64).max
#: Allowance for rounding, as a share of |q| M.
SLACK = 1e-6


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component, all of norm `most`."""
    rest = np.maximum(most * most - (vectors * vectors).sum(axis=1), 0.0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def farthest_first(points: np.ndarray, first: int, most: int, enough: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, the centre (its place in that list) of each point, and the inner product with it.

    Stops at `most` centres, or when every point's product with its own is `enough` (then the radius is small).
    """
    centres, own = [first], np.zeros(len(points), np.int64)
    near = points @ points[first]
    while len(centres) < most and near.min() < enough:
        new = int(near.argmin())
        product = points @ points[new]
        closer = product > near
        closer[new] = True
        own[closer], near[closer] = len(centres), product[closer]
        centres.append(new)
    return centres, own, near


@dataclass
class CoverTree:
    most: np.ndarray  # the norm M, one number
    vectors: np.ndarray  # of the nodes
    uids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray  # children are nodes start to end; none if equal
    end: np.ndarray
    cos: np.ndarray  # of the greatest angle to anything below
    least: np.ndarray  # smallest id below
    lone: np.ndarray  # whether all below have the node's label

    @classmethod
    def build(cls, vectors: np.ndarray, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> CoverTree:
        most = max(1.0, float(np.sqrt((vectors * vectors).sum(axis=1).max())))
        points, square = augmented(vectors, most), most * most
        products = points @ points[0]
        # node: centre, vectors below, smallest product with the centre
        nodes: list[tuple[int, np.ndarray, float]] = [(0, np.arange(len(points)), float(products.min()))]
        start, end = [], []
        for centre, below, worst in nodes:  # grows meanwhile
            start.append(len(nodes))
            if len(below) > 1 or len(nodes) == 1:
                radius = np.arccos(np.clip(worst / square, -1, 1))
                if len(below) <= LEAF or radius <= SLACK:
                    nodes += [(int(p), below[i : i + 1], square) for i, p in enumerate(below)]
                else:
                    first = int(np.flatnonzero(below == centre)[0])
                    centres, own, near = farthest_first(points[below], first, FAN, square * float(np.cos(radius / 2)))
                    for k, c in enumerate(centres):
                        mine = own == k
                        nodes.append((int(below[c]), below[mine], float(near[mine].min())))
            end.append(len(nodes))
        at = np.array([n[0] for n in nodes])
        return cls(
            np.array([most]),
            np.ascontiguousarray(vectors[at]),
            uids[at],
            ids[at],
            labels[at],
            np.array(start),
            np.array(end),
            np.clip(np.array([n[2] for n in nodes]) / square, -1, 1),
            np.array([ids[n[1]].min() for n in nodes]),
            np.array([bool((labels[n[1]] == labels[n[0]]).all()) for n in nodes]),
        )

    def packed(self) -> bytes:
        """The tree as bytes; vectors in the smallest type that holds them exactly."""
        arrays = {f.name: getattr(self, f.name) for f in fields(self)}
        for kind in (np.int16, np.int32):
            small = self.vectors.astype(kind)
            if (small == self.vectors).all():
                arrays["vectors"] = small
                break
        batch = pa.RecordBatch.from_pydict({k: pa.array([a.tobytes()], pa.binary()) for k, a in arrays.items()})
        kinds = {k: f"{a.dtype.str} {a.shape[-1] if a.ndim > 1 else 0}" for k, a in arrays.items()}
        table = pa.Table.from_batches([batch]).replace_schema_metadata(kinds)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        table = pa.ipc.open_stream(data).read_all()
        out = {}
        for f in fields(cls):
            kind, width = table.schema.metadata[f.name.encode()].decode().split()
            array = np.frombuffer(table.column(f.name)[0].as_py(), kind)
            out[f.name] = array.reshape(-1, int(width)) if int(width) else array
        out["vectors"] = out["vectors"].astype(np.float64)
        return cls(**out)

    def descend(self, windows: Windows) -> None:
        """Adds what the tree holds to the windows."""
        scale, take = windows.norm * float(self.most[0]), FIRST
        nodes, ub, lb = np.zeros(1, np.int64), np.full(1, np.inf), np.full(1, -np.inf)
        while len(nodes):
            gains = windows.gains(ub, lb, self.least[nodes])
            nodes, ub, lb = nodes[gains], ub[gains], lb[gains]
            # the best first, more at a time the longer it takes
            order = np.argsort(-windows.reach(ub), kind="stable")
            now, later = order[:take], order[take:]
            take = min(2 * take, MOST)
            at = self._children(nodes[now])
            scores, inner = self.vectors[at] @ windows.query, self.end[at] > self.start[at]
            alone, below = at[~inner], at[inner]
            windows.offer(scores[~inner], self.ids[alone], self.labels[alone], self.uids[alone])
            new_ub, new_lb = bounds(scores[inner], self.cos[below], scale)
            other = self.labels[below] != windows.label
            fits = ~(self.lone[below] & (other if windows.same else ~other))
            nodes = np.concatenate([nodes[later], below[fits]])
            ub, lb = np.concatenate([ub[later], new_ub[fits]]), np.concatenate([lb[later], new_lb[fits]])

    def _children(self, nodes: np.ndarray) -> np.ndarray:
        count = self.end[nodes] - self.start[nodes]
        return np.repeat(self.start[nodes] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def bounds(scores: np.ndarray, cos: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least inner product with anything within the angle of a centre that has this score."""
    c = np.clip(scores / max(scale, 1e-300), -1, 1)
    both, cross = c * cos, np.sqrt((1 - c * c) * (1 - cos * cos))
    ub = np.where(c >= cos, 1.0, both + cross)
    lb = np.where(c <= -cos, -1.0, both - cross)
    return scale * (ub + SLACK), scale * (lb - SLACK)


class Windows:
    """What one query looks for: k vectors of its own label, or of others, in each window of scores."""

    def __init__(self, query, label, uid, same, k, lo, hi, scores=None, ids=None):
        self.query, self.label, self.uid, self.same, self.k = np.asarray(query, np.float64), label, uid, same, k
        self.norm = float(np.sqrt(self.query @ self.query))
        self.lo, self.hi = np.asarray(lo, np.float64), np.asarray(hi, np.float64)
        shape = (len(self.lo), k)
        self.scores = np.full(shape, -np.inf) if scores is None else np.array(scores, np.float64).reshape(shape)
        self.ids = np.full(shape, NONE) if ids is None else np.array(ids, np.int64).reshape(shape)
        self.new = np.zeros(shape, bool)

    def need(self) -> np.ndarray:
        """The score below which a window gains nothing."""
        return np.maximum(self.lo, self.scores[:, -1])

    def reach(self, ub: np.ndarray) -> np.ndarray:
        """The highest score that something with this bound can add to a window."""
        return np.minimum(ub[:, None], self.hi).max(axis=1)

    def gains(self, ub: np.ndarray, lb: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether something with these bounds and this smallest id may get into a window; for each of them."""
        reach, need = np.floor(np.minimum(ub[:, None], self.hi)), self.need()
        last = self.scores[:, -1]
        tie = (last < self.lo) | (least[:, None] <= self.ids[:, -1])
        return (((reach > need) | ((reach == need) & tie)) & (lb[:, None] <= self.hi)).any(axis=1)

    def offer(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, uids: np.ndarray) -> None:
        ok = (labels == self.label) & (uids != self.uid) if self.same else labels != self.label
        some = np.flatnonzero(ok & (scores >= self.need().min()) & (scores <= self.hi.max()))
        scores, ids = scores[some], ids[some]
        fits = (scores >= self.need()[:, None]) & (scores <= self.hi[:, None])
        for j in np.flatnonzero(fits.any(axis=1)):
            mine = fits[j]
            s, i = np.concatenate([self.scores[j], scores[mine]]), np.concatenate([self.ids[j], ids[mine]])
            new = np.concatenate([self.new[j], np.ones(mine.sum(), bool)])
            best = np.lexsort((i, -s))[: self.k]
            self.scores[j], self.ids[j], self.new[j] = s[best], i[best], new[best]
