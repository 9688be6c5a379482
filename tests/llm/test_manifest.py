"""Merkle manifest against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tests_llm_paths import MORE_DIR, no_docs, odd_docs  # noqa: F401

from schemaloom.llm import merkle, queries_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*(value(x) for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and for each node its siblings (before, after) level by level."""
    ways, own, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, at in enumerate(own):
            start = at - at % 8
            ways[i].append(("".join(level[start:at]), "".join(level[at + 1 : start + 8])))
        level, own = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], [at // 8 for at in own]
    return level[0], ways


def brute(rows, tampered):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(*row), row))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for lang in order:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        below[lang] = tree([x[1] for x in groups[lang]])
    root, tops = tree([below[x][0] for x in order]) if order else (None, [])
    out = []
    for lang, top in zip(order, tops, strict=True):
        for (doc_id, own, row), way in zip(groups[lang], below[lang][1], strict=True):
            now = own
            if tampered(doc_id):
                text = row[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
                now = leaf(row[0], text, *row[2:])
            for before, after in way + top:
                now = h(before, now, after)
            proof = h(*(a + b for a, b in way + top))
            out.append((doc_id, own, below[lang][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def third(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def made(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


SIZES = {"en": 600, "de": 64, "fr": 65, "es": 9, "it": 8, "pt": 1, None: 3, "ß": 2, "Z": 1, "aa": 1}


@pytest.mark.parametrize("langs", [list(SIZES), ["en"], ["pt"], ["it", None]])
def test_like_plain_trees(spark, langs):
    rows, k = [], 0
    for lang in langs:
        for i in range(SIZES[lang]):
            k += 7
            rows.append((k, f"Some Text {i} é" if i % 5 else None, lang, f"src{i % 3}" if i % 4 else None, i if i % 6 else None))
    want = brute(rows, third)
    assert got(made(spark, rows)) == want
    assert any(r[6] for r in want)


def test_odd_rows(spark):
    same = (6, "Repeated Row", "en", "a", 3)
    rows = [same] * 20 + [(6, "Another Text", "en", "a", 3), (None, "A", "en", None, None), (None, None, None, None, None), (1, "", "", "", 0), (9, "Ab " * 50_000, "en", "a", 1)]
    want = brute(rows, third)
    assert got(made(spark, rows)) == want
    assert [r for r in want if r[6] is False] and made(spark, []).collect() == []


def test_odd_tables(odd_docs, no_docs):
    docs = odd_docs.select("*", F.lit("en").alias("lang"), F.lit(None).cast("long").alias("n_chars"))
    result = merkle.manifest(docs, F.lit(False))
    assert result.count() == odd_docs.count() and result.where("not verified").count() == 0
    assert merkle.manifest(no_docs.select("*", F.lit("en").alias("lang"), F.lit(1).alias("n_chars")), F.lit(True)).collect() == []


def test_op13(spark):
    import duckdb

    rows = duckdb.connect().execute(f"select doc_id, text, lang, source, n_chars from '{MORE_DIR}/documents.parquet'").fetchall()
    assert got(queries_manifest.op13_merkle_manifest(spark, MORE_DIR)) == brute(rows, third)
