"""Byte-level BPE and token files against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tests_llm_paths import SF_DIR, no_docs, odd_docs, some_docs  # noqa: F401
from tokenizers import Tokenizer

from schemaloom.llm import byte_bpe, queries_tokens, token_files
from schemaloom.llm.perfect_hash import PerfectHash
from schemaloom.llm.pretokens import Remembered
from schemaloom.session import new_folder


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def library_encoder():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return token_files.LibraryEncoder(file.read(), P.PATTERN)


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    table = PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert [table.slot(int(k)) for k in keys[:300]] == table.slots(keys[:300]).tolist()
    strange = np.arange(1, 400, dtype=np.uint64)
    assert [table.slot(int(k)) for k in strange] == table.slots(strange).tolist()
    assert PerfectHash.build(np.zeros(0, np.uint64)).slots(keys[:3]).tolist() == [-1] * 3
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.array([5, 5], np.uint64))


def test_merges_like_the_library(ranks, theirs):
    mine, r = byte_bpe.Encoder(ranks, P.PATTERN), random.Random(3)
    letters = "ab'sS tT\n\r\t\x0b\x1c\x85\xa0  éßſKİ½²٣中あ한😀-<|endoftext|>’re     "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 20_000, " " * 999, "\n \n a  b \n", " lead", "trail "]
    for text in texts:
        ids = mine.encode_text(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_library_model_gives_the_ids_of_whole_texts(library):
    mine, r = library_encoder(), random.Random(4)
    letters = "ab'sS tT\n\r\t\x0b\x1c\x85\xa0  éßſKİ½²٣中あ한😀-<|endoftext|>’re., "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, "<|endoftext|> x", "a" * 5000, " \n x"]:
        assert np.frombuffer(mine.encode_text(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded():
    calls = []
    known = Remembered(lambda x: calls.append(x) or x.encode(), size=2)
    for token in "abcabd":
        known.make_room()
        assert known[token] == token.encode()
    assert len(known) <= 3 and len(calls) < 6


def expected_bpe(rows, theirs):
    out = []
    for doc_id, text in rows:
        ids = np.array(theirs.encode_ordinary(text or ""), "<u4")
        out.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_op5(spark, some_docs, theirs):
    got = queries_tokens.op5_byte_bpe(spark, SF_DIR)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_bpe(some_docs, theirs)


def test_op5_odd(odd_docs, no_docs, ranks, theirs):
    model = byte_bpe.Encoder(ranks, P.PATTERN)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, byte_bpe.digests(odd_docs, model).collect()), key=repr) == expected_bpe(rows, theirs)
    assert byte_bpe.digests(no_docs, model).collect() == []
    with_ids = byte_bpe.encode(odd_docs, model, ids="start")  # a column of that name gives way
    assert with_ids.columns == ["doc_id", "text", "source", "n_tokens", "start"]


def expected_files(rows, library):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_op6(spark, some_docs, library):
    got = queries_tokens.op6_token_files(spark, SF_DIR)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_files(some_docs, library)


def test_op6_odd(spark, odd_docs, no_docs, library):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    path = new_folder(spark)
    token_files.write(odd_docs, library_encoder(), path, shard_ids=100)
    assert sorted(map(tuple, token_files.summary(spark, path).collect()), key=repr) == expected_files(rows, library)
    assert token_files.round_trip(no_docs, library_encoder()).collect() == []


def test_op6_by_key(spark, some_docs, library):
    path = new_folder(spark)
    docs = spark.createDataFrame(some_docs, "doc_id long, text string")
    token_files.write(docs, library_encoder(), path, shard_ids=5000)
    wanted = [some_docs[0][0], some_docs[17][0], some_docs[-1][0], 10**12, -3]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.fetch(spark, path, wanted).collect()}
    texts = dict(some_docs)
    assert got == {k: [*library.encode(texts[k], add_special_tokens=False).ids, 0] for k in wanted if k in texts}


def test_op6_many_keys(spark, some_docs):
    path = new_folder(spark)
    token_files.write(spark.createDataFrame(some_docs, "doc_id long, text string"), library_encoder(), path, shard_ids=5000)
    got = sorted(r.doc_id for r in token_files.fetch(spark, path, list(range(-3000, 3000))).collect())
    assert got == sorted(i for i, _ in some_docs if i is not None and -3000 <= i < 3000)
    assert token_files.fetch(spark, path, []).collect() == []


def test_op6_ids_that_do_not_fit(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    path = new_folder(spark)
    token_files.write(docs, library_encoder(), path, end_id=70_000)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.fetch(spark, path, [1, 2]).collect()}
    assert got[2] == [70_000] and got[1][-1] == 70_000
    with pytest.raises(Exception, match="does not fit"):
        token_files.write(docs, library_encoder(), new_folder(spark), end_id=70_000, width=2)


def test_rank_file_is_read(ranks):
    assert len(ranks) == 50256 and ranks[base64.b64decode("IQ==")] == 0


def test_op6_resolves_added_tokens_like_the_library(spark, tmp_path):
    as_loaded, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(8)
    rows = [(1, "a <|endoftext|> b"), (2, "plain text"), (3, "<|endoftext|><|endoftext|>"), (4, "x<|endoftext|>\n y  "), (5, "<|endoftext|"), (6, None)]
    rows += [(k, "".join(r.choice(["<|endoftext|>", " ", "a", "'s", "\n", "é", "  b"]) for _ in range(12))) for k in range(7, 200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries_tokens.op6_token_files(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == expected_files(rows, as_loaded)
    assert as_loaded.encode(rows[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_op5_a_task_has_one_python_process(odd_docs, ranks, capsys):
    """Encoding and decoding in processes of their own took twice the memory."""
    byte_bpe.digests(odd_docs, byte_bpe.Encoder(ranks, P.PATTERN)).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_words_with_marks_leave_no_entries(ranks):
    """A word with a mark after it, or several pre-tokens, took an entry each beside that of the word."""
    mine, theirs = byte_bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "a qzword, qzword. qzword.\nQzother qzword's qzword-x2 | | 12 12a ..x. é, 中文, a\u0085b x\x1cy 's"
    assert np.frombuffer(mine.encode_text(text), "<u4").tolist() == theirs.encode_ordinary(text)
    assert {"qzword", "|", "12"} <= set(mine.chunks)
    assert not {"qzword,", "qzword.", "qzword.\nQzother", "qzword-x2"} & set(mine.chunks)
    assert mine.encode_text(text) == mine.encode_text(text)


def test_words_with_marks_are_not_put_together_each_time(ranks, theirs):
    mine, asked = byte_bpe.Encoder(ranks, P.PATTERN), []
    split = mine.split
    mine.__dict__["split"] = lambda chunk: asked.append(chunk) or split(chunk)
    text = "Qzword, qzother! say qzword.\nQzline (2,5)... and qz_last\nend.\n"
    for _ in range(2):
        asked.clear()
        assert np.frombuffer(mine.encode_text(text), "<u4").tolist() == theirs.encode_ordinary(text)
    assert asked == [" (2,5", " qz_last"]


def test_marks_and_line_ends_like_the_library(library):
    mine, r = library_encoder(), random.Random(6)
    parts = [*"ab1.,!'s_\n\t|-é中\xa0²\x00\x1c\ŕ", "'s", "ll", " ", " ", ". ", ".\n", "!, "]
    texts = ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(5000)]
    for text in [*texts, "a\n", "a.\n\n", "a \nb", "it's. it's\nit's", "a' b'\nc'", "foo!\t bar"]:
        assert np.frombuffer(mine.encode_text(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
