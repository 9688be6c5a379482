"""Language-model scores of documents: a byte model with partial matching, and a word model as the base.

One reading of every text emits, per task, counts of the training texts' words and byte sequences, and how often each
sequence is to be scored; one aggregation adds them up. All counts are kept: the probability of each distinct sequence
is worked out by joins, level by level. Scoring reads every text once more. Words that make up at least a
2^-`WORD_BITS` share of all training tokens and sequences that make up at least a 2^-`ppm.CACHE_BITS` share of all
bytes (at most 2^20 of each) go to the executors with their exact numbers; the others are joined, so that no key of
these joins is frequent.

Defined results: a null or empty text has one token, its end; a null doc_id counts as the empty text when documents
are held out; repeated rows are scored each and learned from each; without training documents every count is 0; an
empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.llm import ppm
from schemaloom.llm.tables import pieces
from schemaloom.session import cut

WORD_BITS = 20
#: Entries that a task holds before it emits them.
HELD = 300_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def counts(docs: DataFrame) -> DataFrame:
    """word, gram, n, uses: counts of words (gram null), of byte sequences (word null) and of texts (both null).

    docs has text and learned; n counts texts that are learned, uses counts byte sequences of all texts.
    """

    def rows(found: Counter, coded: dict[bool, list[tuple[np.ndarray, np.ndarray]]], texts: int) -> pa.RecordBatch:
        grams = [(learned, *ppm.added(parts)) for learned, parts in coded.items() if parts]
        n = [c if learned else np.zeros_like(c) for learned, _, c in grams]
        codes = [x for _, c, _ in grams for x in c.tolist()]
        return pa.RecordBatch.from_pydict(
            {
                "word": pa.array([*found, *repeat(None, len(codes) + 1)], pa.binary()),
                "gram": pa.array([*repeat(None, len(found)), *codes, None], pa.int64()),
                "n": pa.array([*found.values(), *(x for c in n for x in c.tolist()), texts], pa.int64()),
                "uses": pa.array([*repeat(0, len(found)), *(x for _, _, c in grams for x in c.tolist()), 0], pa.int64()),
            }
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        coded: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        texts = 0
        for whole in batches:
            for batch in pieces(whole, "text", 2 << 20):
                values, learned = _bytes(batch, "text"), batch.column("learned").to_pylist()
                for kind, parts in coded.items():
                    chosen = [x for x, y in zip(values, learned, strict=True) if y == kind]
                    if not chosen:
                        continue
                    if kind:
                        texts += len(chosen)
                        for text in chosen:
                            found.update(text.lower().split())
                    parts.append(ppm.count_grams(chosen))
                    if len(parts) >= 16:
                        parts[:] = [ppm.added(parts)]
                if len(found) > HELD or sum(len(c) for parts in coded.values() for c, _ in parts) > 8 * HELD:
                    yield rows(found, coded, texts)
                    found, coded, texts = Counter(), {True: [], False: []}, 0
        yield rows(found, coded, texts)

    emitted = docs.select("text", "learned").mapInArrow(each, "word binary, gram long, n long, uses long")
    return emitted.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def probabilities(counted: DataFrame, order: int = ppm.ORDER) -> DataFrame:
    """code, uses, log: log10 of the probability of the last byte of each sequence that is used, from all counts.

    A level has a row for each distinct end of the sequences, also with count 0. Each row is joined with its end that
    is a byte shorter; sums over the rows of one context (256 at most) give n and d, and the counts that the next
    shorter context loses by exclusion. What follows an escape depends on the sequence alone, so that it is worked
    out from the shortest level up.
    """
    code, n, d, total = F.col("code"), F.col("n"), F.col("d"), F.col("total")
    levels = [counted.where("gram is not null").select(F.col("gram").alias("code"), "n", "uses")]
    for k in range(order - 1, -1, -1):
        end = code.bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        levels.append(cut(levels[-1].groupBy(end.alias("code")).agg(F.sum("n").alias("n"))))
    context = W.partitionBy(F.shiftright("code", 8))
    shorter = None
    for k, rows in enumerate(reversed(levels)):
        if k:
            rows = rows.withColumn("end", code.bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(shorter, "end")
            rows = rows.withColumn("excluded", F.sum(F.when(n > 0, F.col("end_n")).otherwise(0)).over(context))
        rows = rows.withColumn("total", F.sum("n").over(context)).withColumn("d", F.sum((n > 0).cast("long")).over(context))
        if k:
            n_left, d_left = F.col("end_total") - F.col("excluded"), F.col("end_d") - d
            escape = F.when(d_left > 0, F.log10(d_left) - F.log10(n_left + d_left)).otherwise(0.0) + F.col("end_after")
            after = F.when(F.col("end_n") > 0, F.log10("end_n") - F.log10(n_left + d_left)).otherwise(escape)
        else:
            after = -F.log10(256 - d)
        rows = rows.withColumn("after", after)
        if k < order:
            shorter = cut(rows.select(code.alias("end"), *(F.col(x).alias(f"end_{x}") for x in ("n", "total", "d", "after"))))
    first = F.when(d > 0, F.log10(d) - F.log10(total + d)).otherwise(0.0) + F.col("after")
    return rows.select("code", "uses", F.when(n > 0, F.log10(n) - F.log10(total + d)).otherwise(first).alias("log"))


def score(
    docs: DataFrame, train: Column, text: str = "text", word_bits: int = WORD_BITS, cache_bits: int = ppm.CACHE_BITS
) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score; `train` says what to learn from."""
    spark, kept = docs.sparkSession, docs.columns
    learned = F.coalesce(train, F.lit(False)).alias("learned")
    counted = cut(counts(docs.select(F.col(text).alias("text"), learned)))
    word_counts = counted.where("word is not null").select("word", "n")
    tokens, distinct = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    texts = counted.where("word is null and gram is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    all_tokens, all_words = tokens + texts, distinct + (1 if texts else 0)
    often = F.col("n") >= all_tokens / (1 << word_bits)
    frequent = {bytes(w): float(np.log10(n + 1)) for w, n in word_counts.where(often).toLocalIterator()}  # at most 2^word_bits
    logs = cut(probabilities(counted))
    used = logs.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    cached = F.col("uses") >= used / (1 << cache_bits)
    most = logs.where(cached).select("code", "log").toArrow()  # at most 2^cache_bits rows
    cache = ppm.Table(most.column("code").to_numpy().astype(np.uint64), most.column("log").to_numpy())
    shared = spark.sparkContext.broadcast((cache, frequent))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = shared.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in pieces(whole, text, 2 << 20):
                values = _bytes(batch, text)
                n_tokens, n_known, sums, rare = [], [], [], []
                for value in values:
                    found = value.lower().split()
                    logs = np.fromiter(map(known.get, found, repeat(-1.0)), np.float64, len(found))
                    strange = np.flatnonzero(logs < 0)
                    n_tokens.append(len(found) + 1)
                    n_known.append(len(found) - len(strange))
                    sums.append(float(logs.sum()) + len(strange))
                    rare.append([found[i] for i in strange.tolist()])
                score, (owner, codes, times) = ppm.cached_scores(values, cache)
                ends = pa.array(np.searchsorted(owner, np.arange(len(values) + 1)), pa.int32())
                codes = pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(times, pa.int64())], ["code", "times"])
                made = {
                    "__row": pa.array(range(row, row + len(values)), pa.int64()),
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "__known": pa.array(n_known, pa.int64()),
                    "__sum": pa.array(sums, pa.float64()),
                    "__rare": pa.array(rare, pa.list_(pa.binary())),
                    "__codes": pa.ListArray.from_arrays(ends, codes),
                    "__score": pa.array(score, pa.float64()),
                }
                row += len(values)
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept if c != text} | made)

    schema = docs.drop(text).schema
    rare_codes = T.ArrayType(T.StructType().add("code", "long").add("times", "long"))
    rare_words = T.ArrayType(T.BinaryType())
    for name, kind in (
        ("__row", "long"), ("n_tokens", "long"), ("__known", "long"), ("__sum", "double"), ("__rare", rare_words), ("__codes", rare_codes), ("__score", "double")
    ):
        schema = schema.add(name, kind)
    scored = cut(docs.mapInArrow(each, schema))
    none = F.lit(0)
    words = scored.select("__row", F.explode("__rare").alias("word")).join(word_counts, "word", "left")
    words = words.select(
        "__row", F.log10(F.coalesce("n", none) + 1).alias("more"), F.col("n").isNotNull().cast("long").alias("also"), F.lit(0.0).alias("log")
    )
    codes = scored.select("__row", F.explode("__codes").alias("c")).select("__row", "c.*").join(logs.where(~cached), "code")
    codes = codes.select("__row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("also"), (F.col("times") * F.col("log")).alias("log"))
    rare = words.unionByName(codes).groupBy("__row")
    rare = rare.agg(F.sum("more").alias("__more"), F.sum("also").alias("__also"), F.sum("log").alias("__log"))
    share = float(np.log10(all_tokens + all_words + 1))
    return (
        scored.drop("__rare", "__codes")
        .join(rare, "__row", "left")
        .withColumn("n_known", F.col("__known") + F.coalesce("__also", none) + (1 if texts else 0))
        .withColumn("train_tokens", F.lit(all_tokens).cast("long"))
        .withColumn(
            "base_score",
            F.col("__sum") + F.coalesce("__more", F.lit(0.0)) + float(np.log10(texts + 1)) - F.col("n_tokens") * share,
        )
        .withColumn("score", F.col("__score") + F.coalesce("__log", F.lit(0.0)))
        .drop("__row", "__known", "__sum", "__score", "__more", "__also", "__log")
    )
