"""The pipeline's stages against plain Python, and its rows against the brute-force versions of its operators."""

import re
from collections import Counter

import corpus_pipeline as p
import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from test_benchmark import edits_to_best_part
from test_duplicates import brute as brute_duplicates
from tests_llm_paths import MORE_DIR, SF_DIR, no_docs, odd_docs, some_docs  # noqa: F401

from schemaloom.llm import byte_bpe, decontaminate, quality
from schemaloom.session import cut


def plain_numbers(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_numbers(odd_docs, spark, some_docs):
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(some_docs, "doc_id long, text string"))
    rows = quality.with_numbers(docs).select("text", *quality.NUMBERS).collect()
    assert len(rows) == len(some_docs) + 11
    for r in rows:
        assert tuple(r)[1:] == plain_numbers(r.text), r.text


def test_quality_windows_of_other_lengths(spark):
    text = "a b c d e f a b c x y a b c d"
    docs = spark.createDataFrame([(text,)], "text string")
    for window in (1, 2, 3, 5):
        words = text.split()
        runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        want = len({i + k for i, w in enumerate(runs) if runs.count(w) > 1 for k in range(window)})
        assert quality.with_numbers(docs, window=window).first().n_repeat_words == want


def test_quality_verdicts_by_host(spark, odd_docs, no_docs):
    good, noisy, short = "plain words of a text " * 6, "### $$$ word %% " * 10, "too short"
    texts = [("bad", noisy + f" {i}") for i in range(60)] + [("bad", f"{i} clean words stand in this text here " + " ".join(f"w{i}x{k}" for k in range(30)))  for i in range(3)]
    texts += [(f"h{k % 6}", " ".join(f"v{k}y{j}" for j in range(40))) for k in range(120)] + [("h1", noisy + " ".join(f"u{j}" for j in range(99)) * 3)] + [(None, short)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(quality.with_numbers(docs)).collect()}
    assert [got[i].kept for i in range(60, 63)] == [True] * 3 and not any(got[i].kept for i in range(60))
    assert all(got[63 + k].kept for k in range(120)) and not got[len(texts) - 1].kept and good
    assert quality.judge(quality.with_numbers(no_docs)).collect() == []
    odd = quality.judge(quality.with_numbers(odd_docs.withColumn("n_words", F.lit("clash"))))
    assert odd.count() == 11 and odd.where("text is null and kept").count() == 0


def stages_until(spark, folder, n):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in p.STAGES[:n]:
        docs = cut(stage(spark, docs, folder))
        out.append(docs)
    return out


def test_stages(spark):
    docs, clean, unique, safe, private = stages_until(spark, MORE_DIR, 4)
    for df in (clean, unique, safe, private):
        assert tuple(df.columns) == p.COLUMNS and [t for _, t in df.dtypes] == [t for _, t in docs.dtypes]
    rows = docs.collect()
    passed = {r.doc_id for r in rows if (n := plain_numbers(r.text))[0] >= 20 and 100 * n[4] <= 30 * n[0]}
    kept = {r.doc_id for r in clean.collect()}
    assert kept <= passed and len(passed - kept) < 0.02 * len(passed)
    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in unique.collect()} == {r[0] for r in brute_duplicates(pairs, 5, 80) if r[3]}
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{MORE_DIR}/benchmark.parquet").collect()]
    texts = {r.doc_id: decontaminate.plain(r.text) for r in unique.collect()}
    left = {r.doc_id for r in safe.collect()}
    assert not any(x in texts[i] for i in left for x in items)
    for i in set(texts) - left:
        assert any(edits_to_best_part(x, texts[i]) <= 0.08 * len(x) for x in items if x[:12] in texts[i] or x[-12:] in texts[i])
    real = r"[\w.]+@mail\d\.example\.com|\d{16}|\+1 \(\d{3}\) \d{3}-\d{4}"
    before, after = {r.doc_id: r.text for r in safe.collect()}, private.collect()
    assert len(after) == len(before)
    for r in after:
        found = re.findall(real, before[r.doc_id])
        assert not any(x in r.text for x in found) and r.n_chars == len(r.text)
        assert found or "." in r.text or r.text == before[r.doc_id]


def test_run(spark):
    got = p.run(spark, SF_DIR).collect()
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(p.RANKS)), special_tokens={})
    texts = {r.doc_id: r.text for r in stages_until(spark, SF_DIR, 4)[-1].collect()}
    assert len(got) == len(texts) > 100 and all(r.round_trip for r in got)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == theirs.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4


def test_odd_documents_pass_through(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        df = docs.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars", "1 as ids")
        for _, stage in p.STAGES:
            df = cut(stage(spark, df, SF_DIR))
        rows = df.collect()
        assert {r.doc_id for r in rows} == (set() if docs is no_docs else {7})
