"""Hard negatives against plain Python, and cover trees against comparing everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_paths import MORE_DIR

from schemaloom.llm import hard_negatives, queries_vectors
from schemaloom.llm.cover_tree import CoverTree, Windows

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int, rank string, uid long"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def brute(rows):
    """The query's rows, by comparing each anchor with every row."""
    width = max([len(r[1]) for r in rows if usable(r[1])], default=0)
    table = []
    for vec_id, vector, label, *_ in rows:
        if label is not None and usable(vector):
            whole = [math.floor(256 * float(np.float32(x))) for x in vector] + [0] * (width - len(vector))
            label = label if vec_id is None or vec_id % 7 else (label + 1) % 10
            table.append((vec_id, whole, label))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (anchor, a, label) in enumerate(table):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(x * y for x, y in zip(a, v, strict=True)), vec_id, other == label, k) for k, (vec_id, v, other) in enumerate(table)]
        for score, positive, _, _ in sorted([s for s in scored if s[2] and s[3] != i], key=order)[:5]:
            window = [s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score]
            for rank, found in enumerate(sorted(window, key=order)[:3], 1):
                out.append((anchor, positive, rank, found[1], score, found[0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def mined(spark, rows):
    return hard_negatives.mine(queries_vectors.labelled(spark.createDataFrame(rows, SCHEMA)), anchors=F.col("id") % 50 == 0)


def invented(n, width, seed, groups=12):
    """Vectors around some centres, with exact copies among them."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width))
    rows = centres[r.integers(0, groups, n)] + r.normal(size=(n, width)) * r.choice([0.0, 0.05, 0.4], size=(n, 1))
    return (rows / np.sqrt(width)).astype(np.float32), r.integers(0, 4, n)


@pytest.mark.parametrize(("n", "part_rows"), [(900, None), (1500, 256)])
def test_like_comparing_everything(spark, monkeypatch, n, part_rows):
    vectors, labels = invented(n, 8, n)
    if part_rows:  # several cells, and parts of cells
        monkeypatch.setattr(hard_negatives, "PART_BYTES", part_rows * 64)
        monkeypatch.setattr(hard_negatives, "CELLS", 3)
        monkeypatch.setattr(hard_negatives, "SLICE", 10)
    rows = [(3 * i + 2, v.tolist(), int(x), "x", 0) for i, (v, x) in enumerate(zip(vectors, labels, strict=True))]
    want = brute(rows)
    assert len(want) > 100
    assert got(mined(spark, rows)) == want


def test_odd_rows(spark):
    odd = [
        (50, [1.0, 0.0], 1, "x", 0),
        (50, [1.0, 0.0], 1, "x", 0),  # a repeated anchor
        (100, [0.5, 0.5], 1, None, None),
        (150, None, 1, None, None),
        (200, [1.0, None], 1, None, None),
        (250, [1.0, NAN], 1, None, None),
        (300, [INF, 1.0], 1, None, None),
        (350, [1.0, 1.0], None, None, None),
        (400, [], 1, None, None),
        (450, [-1.0, -1.0], 2, None, None),  # no other row of its label
        (1, [1.0, 0.0, 0.25], 1, None, None),
        (2, [0.75, 0.0], 3, None, None),
        (3, [0.75, 0.0], 3, None, None),  # a tie
        (3, [0.75, 0.0], 3, None, None),
        (4, [0.6, 0.1], 4, None, None),
        (7, [0.8, 0.0], 0, None, None),  # counts as label 1
        (None, [0.75, 0.0], 3, None, None),
        (None, [0.9, 0.0], 1, None, None),
    ]
    want = brute(odd)
    assert {r[0] for r in want} >= {50, 100} and any(r[3] is None for r in want) | any(r[1] is None for r in want)
    assert got(mined(spark, odd)) == want
    assert got(mined(spark, odd[3:9])) == [] and got(mined(spark, [])) == []


def test_too_long_vectors_are_refused(spark):
    with pytest.raises(ValueError, match="too long"):
        mined(spark, [(50, [1e9, 1e9], 1, "x", 0)])


def test_op11(spark):
    import duckdb

    rows = duckdb.connect().execute(f"select vec_id, embedding, label from '{MORE_DIR}/embeddings.parquet'").fetchall()
    assert got(queries_vectors.op11_hard_negatives(spark, MORE_DIR)) == brute(rows)


def test_tree_finds_what_comparing_finds_and_skips_the_rest():
    vectors, labels = invented(6000, 6, 3)
    whole, ids = np.floor(vectors.astype(float) * 256), np.arange(6000)[::-1].copy()
    tree = CoverTree.unpacked(CoverTree.build(whole, ids, ids, labels).packed())
    alone = tree.start == tree.end
    assert sorted(tree.ids[alone].tolist()) == list(range(6000))  # every vector once
    opened = []
    children = tree._children
    tree._children = lambda nodes: opened.append(at := children(nodes)) or at
    for i in range(0, 6000, 500):
        scores = whole @ whole[i]
        for same, lo, hi in ((True, -np.inf, np.inf), (False, 0.5 * scores[i] // 1, 0.9 * scores[i] // 1)):
            windows = Windows(whole[i], labels[i], ids[i], same, 4, [lo], [hi])
            tree.descend(windows)
            fits = ((labels == labels[i]) & (ids != ids[i]) if same else labels != labels[i]) & (scores >= lo) & (scores <= hi)
            best = sorted(zip(-scores[fits], ids[fits], strict=True))[:4]
            assert [(-s, k) for s, k in zip(windows.scores[0], windows.ids[0], strict=True)][: len(best)] == [(s, k) for s, k in best]
    assert sum(map(len, opened)) < 24 * len(tree.start) / 2


def test_bounds_hold_for_everything_below():
    vectors, labels = invented(2000, 5, 4)
    ids = np.arange(2000)
    tree = CoverTree.build(vectors.astype(float), ids, ids, labels)
    from schemaloom.llm.cover_tree import bounds

    query = vectors[7].astype(float) * 3

    def below(node):
        if tree.start[node] == tree.end[node]:
            return [node]
        return [x for c in range(tree.start[node], tree.end[node]) for x in below(c)]

    scale = float(np.linalg.norm(query)) * float(tree.most[0])
    for node in np.flatnonzero(tree.end > tree.start)[:40]:
        own = tree.vectors[below(node)] @ query
        ub, lb = bounds(tree.vectors[node : node + 1] @ query, tree.cos[node : node + 1], scale)
        assert lb[0] <= own.min() and own.max() <= ub[0]
        assert tree.least[node] == tree.ids[below(node)].min()
