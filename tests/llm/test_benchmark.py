"""Matches of benchmark items against aligning every item with every text."""

import random

import numpy as np
import pytest
from tests_llm_paths import MORE_DIR, SF_DIR, no_docs, odd_docs  # noqa: F401

from schemaloom.llm import decontaminate as d
from schemaloom.llm import queries_benchmark


def edits_to_best_part(item, text):
    """Plain dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[at] = r.choice("xyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, r.choice("xyz"))
    return "".join(out)


def invented(r, n):
    return " ".join("".join(r.choice(("the", "an", "er", "in", "ti", "é")) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_like_aligning_everything():
    r = random.Random(4)
    items = [(i, invented(r, r.randint(1, 25))) for i in range(25)]
    texts = []
    for _ in range(120):
        _, item = r.choice(items)
        near = edited(r, item, r.randint(0, 1 + len(item) // 10)) if len(item) > 3 else item
        texts.append(d.plain(invented(r, r.randint(0, 20)) + " " + near + " " + invented(r, r.randint(0, 20))))
    texts += ["", "x"]
    prepared = d.Items(items)
    got = [{m["item_id"] for m in x} for x in prepared.find(texts)]
    want = [{i for i, t in items if edits_to_best_part(d.plain(t), x) <= int(len(d.plain(t)) * d.EDITS)} for x in texts]
    assert got == want and sum(map(len, want)) > 60
    for text, found in zip(texts, prepared.find(texts), strict=True):
        for m in found:
            item = d.plain(dict(items)[m["item_id"]])
            assert edits_to_best_part(item, text[m["start"] : m["end"]]) == m["edits"]


def test_rolling_hashes():
    codes = d._codes("abcabcabxabc")
    for length in range(1, 13):
        hashes = d.rolling(codes, length).tolist()
        runs = [tuple(codes[i : i + length].tolist()) for i in range(len(codes) - length + 1)]
        assert len(set(zip(hashes, runs, strict=True))) == len(set(hashes)) == len(set(runs))
    assert len(d.rolling(codes, 13)) == 0


@pytest.mark.parametrize("folder", [SF_DIR, MORE_DIR])
def test_op9(spark, duck, folder):
    import duckdb

    c = duckdb.connect()
    docs = c.execute(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    items = c.execute(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()
    got = queries_benchmark.op9_decontaminate(spark, folder).collect()
    whole = {(i, k) for i, t in docs for k, x in items if d.plain(x) in d.plain(t)}
    assert whole <= {(r.doc_id, r.item_id) for r in got} and len(whole) > 2
    texts, own = dict(docs), dict(items)
    for r in got:
        item = d.plain(own[r.item_id])
        assert r.edits <= len(item) * d.EDITS
        assert edits_to_best_part(item, d.plain(texts[r.doc_id])[r.start : r.end]) == r.edits


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "Mixed case  words, ſtrange", "x"), (2, None, "x"), (3, "", "x"), (4, "again and again", "x"), (5, "again and again", "x"), (None, "hunter22", "x")],
        "item_id long, text string, matches string",
    )
    for block in (d.BLOCK_CHARS, 20):
        got = d.with_matches(odd_docs, items, block_chars=block)
        assert got.columns == [*odd_docs.columns, "matches"]
        found = [(r.doc_id, sorted((m.item_id or 0, m.start) for m in r.matches)) for r in got.collect()]
        by = dict(found)
        assert [len(x) for i, x in found if i == 6] == [24, 24] and len(by[5]) == 24
        assert by[9] == [(1, 0)] and by[8] == [(0, 11)] and by[1] == by[2] == by[3] == []
    assert d.pairs(no_docs, items).collect() == []
    assert d.pairs(odd_docs, items.limit(0)).collect() == []
    assert d.with_matches(odd_docs, items.limit(0)).where(d.clean()).count() == 11


def test_long_texts_are_searched_whole():
    item = "the item that stands at the very end of a long text"
    text = d.plain("word " * 60_000 + item)
    assert d.Items([(1, item)]).find([text, text])[1][0]["end"] == len(text)
    assert np.array_equal(d.rolling(d._codes(""), 3), np.zeros(0, np.uint64))
