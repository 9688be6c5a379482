"""Near-duplicates against comparing every pair of full sets."""

import random
from collections import defaultdict

import numpy as np
import pytest
from tests_llm_paths import MORE_DIR, no_docs, odd_docs  # noqa: F401

from schemaloom.llm import hyperminhash as hmh
from schemaloom.llm import near_duplicates as nd
from schemaloom.llm import queries_duplicates


def set_of(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    """doc_id, size of the set, component, kept."""
    sets = [set_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        near = {root(k) for x in s for k in holders[x]}
        for k in {k for x in s for k in holders[x]} if near else ():
            inner = len(s & sets[k])
            if root(k) != root(i) and 100 * inner >= percent * (len(s) + len(sets[k]) - inner):
                parent[root(k)] = root(i)
        for x in s:
            holders[x].append(i)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        comp = min((x for x in least[root(i)] if x is not None), default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), comp, comp is None or doc_id == comp))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def copies(r, base, most):
    words = base.split()
    for _ in range(r.randint(0, most)):
        at = r.randrange(len(words))
        if r.random() < 0.5:
            words[at] = f"n{r.randrange(10**6)}"
        else:
            del words[at]
        words = words or ["x"]
    return " ".join(words)


def invented(r, n):
    return " ".join(f"w{r.randrange(4000)}" for _ in range(n))


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 2048), (5, 80, 7)])
def test_like_comparing_all_pairs(spark, size, percent, block):
    r = random.Random(size)
    rows = []
    for _ in range(60):
        base = invented(r, r.choice((1, 2, 3, 4, 6, 8, 12, 30, 80, 300)))
        rows += [copies(r, base, max(1, len(base.split()) // 12)) for _ in range(r.randint(1, 5))]
    base = invented(r, 120)  # a large group whose members are linked through one another
    rows += [copies(r, base, 8) for _ in range(150)]
    chain = invented(r, 200).split()
    for i in range(40):
        chain[i * 4 : i * 4 + 2] = [f"c{i}", f"d{i}"]
        rows.append(" ".join(chain))
    rows += [base] * 30 + [base.upper()] + ["", None, " \n"]
    r.shuffle(rows)
    rows = list(enumerate(rows, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(nd.near_duplicates(docs, size, percent, block)) == brute(rows, size, percent)


def test_odd(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    result = nd.near_duplicates(odd_docs, 3, 85)
    assert got(result) == brute(rows, 3, 85)
    assert [r.component_id for r in result.where("doc_id = 6").collect()] == [5, 5]
    assert nd.near_duplicates(no_docs, 3, 85).collect() == []


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for x in parent if root(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {row.v: row.comp for row in nd.components(df).collect()} == want
    assert nd.components(df.limit(0)).collect() == []


def test_estimates_are_near():
    r = np.random.default_rng(1)
    for size, share in ((2000, 0.9), (2000, 0.3), (300, 0.85), (40, 0.8)):
        errors = []
        for _ in range(60):
            a = r.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)
            b = np.concatenate([a[: int(size * share)], r.integers(0, 2**63, size - int(size * share)).astype(np.uint64) * np.uint64(2)])
            true = int(size * share) / (2 * size - int(size * share))
            regs = hmh.registers([np.sort(a), np.sort(b)])
            errors.append(float(hmh.similarity(regs[0], regs[1])) - true)
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 5 * np.sqrt(0.25 / min(size, hmh.BUCKETS))


def test_registers_hold_zeros_and_mantissa():
    hashes = np.array([(5 << 57) | (1 << 50) | (0b1011 << 46)], np.uint64)
    row = hmh.registers([hashes])[0]
    assert set(row.tolist()) == {(6 << 10) | 0b1011000000}
    many = np.unique(np.random.default_rng(2).integers(0, 2**63, 10**5).astype(np.uint64) * np.uint64(2))
    assert len(set(hmh.registers([many])[0].tolist())) > 60


def test_op1(spark):
    import duckdb

    rows = duckdb.connect().execute(f"select doc_id, text from '{MORE_DIR}/documents.parquet'").fetchall()
    assert got(queries_duplicates.op1_near_duplicates(spark, MORE_DIR)) == brute(rows, 3, 85)


def test_one_row_of_each_stays(spark, odd_docs, no_docs):
    got_ids = sorted((repr(r.doc_id), r.n_tokens) for r in nd.first_of_each(odd_docs, 3, 85).collect())
    assert got_ids == sorted((repr(i), "x") for i in (1, 2, 3, 4, 5, 7, 8, 9, None))
    rows = [(None, "two words twice"), (None, "two words twice"), (3, "x y z a"), (3, "x y z a"), (4, "x y z a"), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, map(tuple, nd.first_of_each(docs, 3, 85).collect()))) == sorted(
        ["(None, 'two words twice')", "(3, 'x y z a')", "(5, None)", "(5, None)"]
    )
    assert nd.first_of_each(no_docs).collect() == []


def test_marks_lose_no_row_and_full_ones_only_keep_more(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i if i % 9 else None, f"text {i}", "x") for i in range(3000)], "doc_id long, text string, lang string")
    keys = docs.where("text like '%7%'").select("doc_id", F.xxhash64("text").alias("t"))
    wanted = {r["text"] for r in docs.where("text like '%7%'").collect()}
    every = {r["text"] for r in docs.collect()}
    marks = nd.Marks(keys, 27)
    inside, outside = ({r["text"] for r in marks.rows(docs, wanted=x).collect()} for x in (True, False))
    assert wanted <= inside and inside | outside == every and not inside & outside
    assert len(inside) < 1.2 * len(wanted) and marks.rows(docs, wanted=True).schema == docs.schema
    full = nd.Marks(keys, 15).rows(docs, wanted=True)  # hardly any room left
    assert wanted <= {r["text"] for r in full.collect()}
    assert nd.Marks(keys.limit(0), 27).rows(docs, wanted=True).collect() == []
