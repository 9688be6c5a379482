"""Licence scan against plain Python."""

import re

import pytest
from tests_llm_paths import SF_DIR, no_docs, odd_docs  # noqa: F401

from schemaloom.llm import license_scan, queries_licenses
from schemaloom.llm.license_templates import NOTICES, PHRASES

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    """n_words, places of phrases, their labels: by looking at every place."""
    own = words_of(text)
    places = [(i, label) for label, p in PHRASES for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def bands(text):
    """Labels and best score of notices: places that fall into a band of diagonals, for every band there is."""
    own, found = words_of(text), {}
    k, shift, share = license_scan.K, license_scan.SHIFT, license_scan.SHARE
    for number, (label, notice) in enumerate(NOTICES):
        want, held = words_of(notice), {}
        for i in range(len(own) - k + 1):
            for j in range(len(want) - k + 1):
                if own[i : i + k] == want[j : j + k]:
                    for b in ((i - j) // shift, (i - j) // shift - 1):
                        held.setdefault(b, []).append((i, j))
        for hits in held.values():
            covered = len({j + x for _, j in hits for x in range(k)})
            span = max(i for i, _ in hits) + k - min(i for i, _ in hits)
            score = 2 * covered / (len(want) + span)
            if covered >= share * len(want) and score >= share:
                found[number, label] = max(score, found.get((number, label), 0))
    return {label for _, label in found}, max(found.values(), default=0.0)


def check(df, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in df.select(*COLUMNS).collect()}
    assert len(got) == len({i for i, _ in rows})
    for doc_id, text in rows:
        n, count, first, last, labels = base(text)
        more, score = bands(text)
        every = ",".join(sorted(more | set(filter(None, labels.split(",")))))
        assert got[doc_id] == (n, count, first, last, labels, every, 1.0 if count else pytest.approx(score)), text
    return got


MIT, APACHE = NOTICES[0][1], next(t for label, t in NOTICES if label == "apache-2")

TEXTS = [
    "Released under the MIT License.",
    "UNDER THE mit-license under the mit license, cc by-nc; CC_BY NC",
    "under the\nmit\x00license and ſunder the mit license",
    "the apache license, version 2.0 or the Apache License Version 2",
    "under the mit licence; cc by; apache license version",
    f"word {'x ' * 300}{MIT} and {'y ' * 50}{APACHE}",
    f"{MIT} {MIT}",
    MIT.replace("free of charge", "wholly free of any charge").replace("merge, publish,", ""),
    " ".join(MIT.split()[:60]),  # less than the share of the notice
    "the software of the software and the software " * 200,
    "cc by nc " * 400,
]


def test_like_looking_at_every_place(spark):
    rows = list(enumerate(TEXTS))
    got = check(license_scan.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), rows)
    assert [got[i][5] for i in (0, 6, 7)] == ["mit"] * 3 and got[5][5] == "apache-2,mit" and got[8][5] == ""
    assert got[10][1] == 400 and got[7][6] < 1


def test_blocks_of_templates(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BLOCK", 50)
    rows = list(enumerate(TEXTS))
    check(license_scan.summary(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_odd(odd_docs, no_docs):
    got = license_scan.summary(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r["labels"] for r in got} == {""}
    assert {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert next(r["n_words"] for r in got if r["doc_id"] == 7) == 40_000
    assert license_scan.summary(no_docs).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[0]), (None, None), (1, "nothing")]
    got = sorted(map(repr, (tuple(r) for r in license_scan.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    one = (5, 1, 1, 1, "mit", "mit", 1.0)
    assert got == sorted(map(repr, [(1, *one), (1, *one), (None, *one), (None, 0, 0, None, None, "", "", 0.0), (1, 1, 0, None, None, "", "", 0.0)]))


def test_spans(spark):
    found = license_scan.spans(spark.createDataFrame([(5, f"a b c {APACHE} d e")], "doc_id long, text string")).where("not phrase and label = 'apache-2'")
    best = max(found.collect(), key=lambda r: r["last"] - r["first"])
    assert (best["first"], best["last"], best["score"]) == (3, 2 + len(words_of(APACHE)), 1.0)


def test_op12(spark, duck):
    rows = duck.execute("select doc_id, text from documents").fetchall()
    check(queries_licenses.op12_license_scan(spark, SF_DIR), rows)
