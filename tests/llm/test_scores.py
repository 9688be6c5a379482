"""Partial matching against a plain recursive model; word scores against counting."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_paths import SF_DIR, no_docs, odd_docs, some_docs  # noqa: F401

from schemaloom.llm import lm_scores, ppm, queries_scores


class Plain:
    """The same model, one byte at a time."""

    def __init__(self, texts, order=ppm.ORDER):
        self.order, self.counts = order, defaultdict(Counter)
        for text in texts:
            data = b"\xff" * order + text + b"\xff"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.counts[data[i - k : i]][data[i]] += 1

    def score(self, text):
        data = b"\xff" * self.order + text + b"\xff"
        return sum(self.byte(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))

    def byte(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = {s: n for s, n in self.counts.get(context[self.order - k :], {}).items() if s not in excluded}
            n, d = sum(seen.values()), len(seen)
            if symbol in seen:
                return out + math.log10(seen[symbol] / (n + d))
            if d:
                out += math.log10(d / (n + d))
                excluded |= set(seen)
        return out - math.log10(256 - len(excluded))


def trie_of(texts, order=ppm.ORDER):
    codes, n = ppm.count_grams(texts, order)
    return ppm.Trie([ppm.added([(codes & np.uint64((1 << (8 * (k + 1))) - 1), n)]) for k in range(order + 1)])


def test_trie_scores_like_the_plain_model():
    r = random.Random(5)
    texts = ["".join(r.choice("abc é") for _ in range(r.randint(0, 60))).encode() for _ in range(60)]
    train, rest = texts[:40], [*texts, "zebra ÿ ab".encode(), b"", b"a"]
    plain, trie = Plain(train), trie_of(train)
    np.testing.assert_allclose(trie.scores(rest), [plain.score(x) for x in rest], rtol=1e-9)
    np.testing.assert_allclose(trie_of([]).scores([b"ab"]), [-3 * math.log10(256)])


def test_probabilities_sum_to_one():
    trie = trie_of([b"abracadabra", b"abba", b"", "é".encode()])
    for context in (b"abra", b"zzzz", b"\xff\xff\xff\xff", b"xxxa"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs(np.sum(10 ** trie.log10(codes)) - 1) < 1e-9


def expected(rows):
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    words = [(i, (t or "").encode(), (t or "").encode().lower().split()) for i, t in rows]
    count = Counter(w for i, _, ws in words if not held[i] for w in ws)
    end = sum(not held[i] for i, _, _ in words)
    n, v = sum(count.values()) + end, len(count) + bool(end)
    plain, out = Plain([t for i, t, _ in words if not held[i]]), []
    for i, text, ws in words:
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count[w] for w in ws), end])
        out.append((i, held[i], len(ws) + 1, sum(count[w] > 0 for w in ws) + bool(end), n, base, plain.score(text)))
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    got, want = (sorted(x, key=lambda r: (repr(r[:5]), r[6])) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("bits", [20, 3])
def test_odd(odd_docs, bits):
    held = lm_scores.held_out(F.col("doc_id"))
    docs = odd_docs.select("doc_id", "text").withColumn("held_out", held)
    got = lm_scores.score(docs, ~held, word_bits=bits).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
    same(got.collect(), expected([(r.doc_id, r.text) for r in odd_docs.collect()]))


def test_empty(no_docs):
    held = lm_scores.held_out(F.col("doc_id"))
    assert lm_scores.score(no_docs, ~held).collect() == []


def test_op3(spark, some_docs):
    same(queries_scores.op3_lm_scores(spark, SF_DIR).collect(), expected(some_docs))


def test_op3_ranks_language_above_noise(spark, some_docs):
    held = lm_scores.held_out(F.col("doc_id"))
    noise = [(10**9 + k, "".join(random.Random(k).sample(t, len(t)))) for k, (_, t) in enumerate(some_docs[:40])]
    noise = [(i, t) for i, t in noise if zlib.crc32(str(i).encode()) % 7 == 2 and t]
    docs = spark.createDataFrame([*some_docs, *noise], "doc_id long, text string")
    per_byte = {r.doc_id: r.score / (len(r.text.encode()) + 1) for r in lm_scores.score(docs.withColumn("t", F.col("text")), ~held, text="t").collect()}
    plain = [per_byte[i] for i, _ in some_docs]
    assert noise and max(per_byte[i] for i, _ in noise) < np.median(plain)


@pytest.mark.parametrize("cache_bits", [20, 6, 0])
def test_all_counts_are_kept(spark, cache_bits):
    """More than 2^20 training bytes, so that rare sequences lie below a 2^-20 share; small caches leave all to the joins."""
    r = random.Random(6)
    rows = [(k, "".join(r.choice("abcdefgh éß ") for _ in range(120))) for k in range(300)]
    rows += [(1000 + k, " ".join([r.choice(("often", "seen", "words"))] * 40_000)) for k in range(8)] + [(2000, "zebra ÿ"), (2001, ""), (2002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lm_scores.held_out(F.col("doc_id"))
    assert sum(len((t or "").encode()) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2) > 1 << 20
    got = lm_scores.score(docs.withColumn("held_out", held), ~held, cache_bits=cache_bits).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
    same(got.collect(), expected(rows))


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scores.score(docs, F.lit(False), cache_bits=0).collect()}
    assert got == pytest.approx({1: -3 * math.log10(256), 2: -math.log10(256)})
