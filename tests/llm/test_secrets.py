"""Secret scans against running every expression over every text."""

import hashlib
import random
import re

from tests_llm_paths import SF_DIR, no_docs, odd_docs, some_docs  # noqa: F401

from schemaloom.llm import queries_secrets, secret_scan
from schemaloom.llm.secret_scan import BASE, MORE, RULES, Rule, trigram_query


def brute(text, rules):
    return sorted(
        (m.start(), k, m.end())
        for k, r in enumerate(rules)
        for m in re.compile(r.pattern, r.flags).finditer(text or "")
        if r.holds(m)
    )


def test_queries_of_rules():
    by = {r.kind: trigram_query(r) for r in RULES}
    assert by["hex"] is None
    assert by["access"] == ("and", ("aki", "kia"))
    assert by["assign"][0] == "or" and ("and", ("tok", "oke", "ken")) in by["assign"][1]
    assert by["login"] == "://"
    assert trigram_query(Rule("x", "ab[cd]+e")) == ("or", ("abc", "abd"))
    assert trigram_query(Rule("x", "abcd?|xyz")) == ("or", ("abc", ("and", ("abc", "bcd")), "xyz"))
    assert trigram_query(Rule("x", "(abc)*x")) is None and trigram_query(Rule("x", "a.c")) is None
    assert trigram_query(Rule("x", "(?:foo|.)bar")) == "bar"


def pieces_of_secrets(r):
    letters = "".join(r.choice("abcdef0123456789") for _ in range(r.randint(10, 40)))
    return r.choice(
        [
            f"ToKeN = '{letters}'", "PASSWORD:abc", "password:abcdef", f"api_key={letters}", f"apikey : {letters}", "passwd=short",
            f"token=password=x{letters}", "AKIA" + letters.upper(), "AKIAAKIA" + "Z" * r.randint(5, 20), letters, "ſecret=abcdefgh",
            "toKen = abcdefghij", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "aB3" * 13, "xoxb-1234567890-ab", "AIza" + "x" * 35,
            "eyJ" + letters + ".eyJ" + letters + "." + letters, "ftp://user:secret@host", "é中😀", "\n", " ", "the word",
        ]
    )


def test_like_scanning_everything():
    r = random.Random(2)
    texts = [" ".join(pieces_of_secrets(r) for _ in range(r.randint(0, 6))) for _ in range(1500)]
    texts += ["".join(pieces_of_secrets(r) for _ in range(r.randint(0, 4))) for _ in range(1500)]
    for rules in (RULES, BASE, MORE, (Rule("x", "(?:foo|.)d"), Rule("y", "(token|a)+ "))):
        assert secret_scan.scan_texts(texts, rules) == [brute(t, rules) for t in texts]
    assert secret_scan.scan_texts([], RULES) == []


def expected(rows):
    out = []
    for doc_id, text in rows:
        found = brute(text, RULES)
        spans = [f"{RULES[k].kind}:{a}:{b}" for a, k, b in found]
        base = [f"{RULES[k].kind}:{a}:{b}" for a, k, b in found if k < len(BASE)]
        counts = [sum(k == i for _, k, _ in found) for i in range(3)]
        out.append((doc_id, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans)))
    return sorted(out, key=repr)


def test_op4(spark, some_docs):
    got = queries_secrets.op4_secret_scan(spark, SF_DIR)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(some_docs)


def test_op4_odd(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, secret_scan.summary(odd_docs).collect()), key=repr) == expected(rows)
    assert secret_scan.summary(no_docs).collect() == []
    assert secret_scan.scan(odd_docs, spans="start").columns == ["doc_id", "text", "source", "n_tokens", "start"]
