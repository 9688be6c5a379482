"""Secrets in texts by rules, behind an inverted index of trigrams.

From each rule's regular expression a Boolean query over trigrams is derived that every match fulfils. A block of
texts is indexed: for each trigram that some query names, the rows that hold it (postings, from one pass over the
bytes of the block). Intersections and unions of postings give a rule's candidate rows, and the expression itself is
run over the whole text of these only. Rules without mandatory trigrams run over every text.

Index and texts of a block live in one task, so nothing is shuffled and nothing is sent to the driver.

Defined results: a null or empty text has no spans; texts are never cut; spans count code points, the end exclusive;
repeated rows are scanned each; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from re import _constants as kinds
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.tables import pieces


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; those that `holds` refuses are dropped after they were found."""

    kind: str
    pattern: str
    flags: int = 0
    holds: Callable[[re.Match], bool] = field(default=lambda m: True, compare=False)


BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        lambda m: len(m[2]) >= 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", holds=lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]+", holds=lambda m: len(m[0]) >= 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", re.ASCII),
)
RULES = BASE + MORE

# Boolean queries: None holds for every text, a string is one trigram, a pair is ("and" | "or", queries).
Query = None | str | tuple
#: Strings that a part of an expression may stand for, beyond which they are no longer listed.
LISTED = 64


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _holds(strings: set[str]) -> Query:
    """Some one of the strings is in the text."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _characters(items: list) -> set[str] | None:
    """Lower-case characters of a class, None if it has many."""
    out: set[str] = set()
    for kind, value in items:
        low, high = value if kind is kinds.RANGE else (value, value)
        if kind not in (kinds.RANGE, kinds.LITERAL) or high - low >= LISTED:
            return None
        out |= {chr(c).lower() for c in range(low, high + 1)}
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The strings that a sequence may stand for (None: not listed), and what else must hold."""
    run: set[str] | None = {""}
    must: list[Query] = []

    def close() -> None:
        nonlocal run
        if run:
            must.append(_holds(run))
        run = {""}

    whole = True
    for kind, value in tree:
        part: set[str] | None = None
        if kind is kinds.LITERAL:
            part = {chr(value).lower()}
        elif kind is kinds.IN:
            part = _characters(value)
        elif kind is kinds.SUBPATTERN:
            part, more = _walk(value[3])
            must.append(more)
        elif kind is kinds.BRANCH:
            each = [_walk(x) for x in value[1]]
            if all(strings is not None for strings, _ in each):
                part = set().union(*(strings for strings, _ in each))
            else:
                must.append(_any([_all([more, _holds(s) if s else None]) for s, more in each]))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            least, most, item = value
            strings, more = _walk(item)
            if least:
                must.append(more)
            if strings is not None and (least, most) == (0, 1):
                part = strings | {""}
            elif strings is not None and 0 < least <= 8:
                part = reduce(lambda a, b: {x + y for x in a for y in b}, [strings] * least)
                if most != least and len(part) <= LISTED:
                    run = {a + b for a in run for b in part}
                    part = None
        elif kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
            part = {""}
        if part is None or len(part) * len(run) > LISTED:
            close()
            whole = False
            run = part if part is not None and len(part) <= LISTED else {""}
        else:
            run = {a + b for a in run for b in part}
    if whole:
        return run, _all(must)
    close()
    return None, _all(must)


def trigram_query(rule: Rule) -> Query:
    """What every text with a match fulfils, over its lower-case ASCII letters; None if nothing is mandatory."""
    strings, more = _walk(_parser.parse(rule.pattern, rule.flags))
    return _all([more, _holds(strings) if strings is not None else None])


def trigrams(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*map(trigrams, query[1]))
    return set() if query is None else {query}


class Index:
    """Postings of the wanted trigrams over a block of texts."""

    def __init__(self, texts: list[str], wanted: list[str]):
        codes = {int.from_bytes(t.encode(), "big"): i for i, t in enumerate(wanted) if t.isascii()}
        lookup = np.full(1 << 24, -1, np.int16)
        lookup[list(codes)] = list(codes.values())
        self.rows, self.lookup, self.numbers = len(texts), lookup, {t: i for i, t in enumerate(wanted)}
        self.postings = self._read(texts)

    def _read(self, texts: list[str]) -> list[np.ndarray]:
        encoded = [x.encode("utf-8", "surrogatepass").lower() for x in texts]
        data = np.frombuffer(b"\n\n".join(encoded) + b"\n\n", np.uint8).astype(np.uint32)
        begins = np.cumsum([0, *(len(x) + 2 for x in encoded)])[:-1]
        found = self.lookup[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(found >= 0)
        rows = np.searchsorted(begins, at, "right") - 1
        pairs = np.unique(found[at].astype(np.int64) * max(1, self.rows) + rows)
        number, row = np.divmod(pairs, max(1, self.rows))
        cuts = np.searchsorted(number, np.arange(len(self.numbers) + 1))
        return [row[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def find(self, query: Query) -> np.ndarray:
        """Rows that fulfil a query."""
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[self.numbers[query]] if query.isascii() else np.arange(self.rows)
        parts = sorted((self.find(x) for x in query[1]), key=len)
        return reduce(lambda a, b: np.intersect1d(a, b, True), parts) if query[0] == "and" else reduce(np.union1d, parts)


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans: start, number of the rule, end; in this order."""
    queries = [trigram_query(r) for r in rules]
    index = Index(texts, sorted(set().union(*map(trigrams, queries))))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        search = re.compile(rule.pattern, rule.flags).finditer
        for row in index.find(query).tolist():
            out[row].extend((m.start(), number, m.end()) for m in search(texts[row]) if rule.holds(m))
    return [sorted(x) for x in out]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", spans: str = "found") -> DataFrame:
    """docs with an array of spans (start, kind, end), by start and then in the order of the rules."""
    kept = [c for c in docs.columns if c != spans]
    schema = docs.select(*kept).schema.add(spans, _kind(docs))
    made = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text, 4 << 20):
                found = scan_texts([x or "" for x in batch.column(text).to_pylist()], rules)
                column = [[{"start": a, "kind": rules[k].kind, "end": b} for a, k, b in x] for x in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(column, made)], [*kept, spans])

    return docs.select(*kept).mapInArrow(each, schema)


def _kind(docs: DataFrame):
    made = "cast(null as array<struct<start: bigint, kind: string, end: bigint>>) as x"
    return docs.selectExpr(made).schema["x"].dataType


def summary(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    scanned = scan(docs.select("doc_id", "text"), rules).drop("text")
    basic = F.filter("found", lambda x: x["kind"].isin(*(r.kind for r in base)))
    return scanned.select(
        "doc_id",
        *(F.size(_of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in base),
        F.sha2(_written(basic).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )


def _of_kind(kind: str) -> Column:
    return F.filter("found", lambda x: x["kind"] == kind)


def _written(spans: Column) -> Column:
    parts = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(parts, ",")
