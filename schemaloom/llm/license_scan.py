"""Licences in texts by diagonal voting over word k-grams.

1. Every run of `K` words of a text is hashed and joined with the runs of the templates: a hit is a place in the text
   and a place in a template. Its words are compared at once, so that equal hashes are no proof.
2. Hits vote for their diagonal (place in the text less place in the template). A phrase is found where all its runs
   stand on one diagonal.
3. Words put in or left out move the rest of a notice to a neighbouring diagonal. Neighbours are merged in overlapping
   bands of 2 * `SHIFT` diagonals that begin every `SHIFT`, so that a group never holds more than a template's places
   and a span is never longer than its template and 2 * `SHIFT` words.
4. A merged span is verified by the words it covers: at least `SHARE` of the template's, and at least `SHARE` as twice the words
   covered over the words of template and span together, which is its score. Of neighbouring bands that see the same span
   the best counts, or the first of equal ones.

Templates go to the executors in blocks of at most `BLOCK` runs, as many as they need. Nothing but hits is shuffled.

Defined results: null and empty texts have no words and no spans; texts are taken whole, however long; rows that
repeat doc_id and text have equal results; a null doc_id is an id like others; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.llm.license_templates import NOTICES, PHRASES

K = 3
SHIFT = 16
SHARE = 0.7
BLOCK = 100_000
#: What does not belong to a word, after A-Z became small.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def runs(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    """label, phrase (or notice), template, its words, place, run: one row for each run of words of each template."""
    out = []
    for number, (label, text, phrase) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        own = template_words(text)
        if len(own) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        out += [(label, phrase, number, len(own), i, own[i : i + K]) for i in range(len(own) - K + 1)]
    return out


def _hits(texts: DataFrame, spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Places of texts (doc_id, t, w) where a run of a template stands."""
    table = spark.createDataFrame(rows, "label string, phrase boolean, template int, size int, place int, run array<string>")
    table = table.withColumn("hash", F.xxhash64(*(F.col("run")[i] for i in range(K))))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - K), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(K))))
    places = texts.where(F.size("w") >= K).select("doc_id", "t", "w", F.posexplode(hashes).alias("at", "hash"))
    found = places.join(F.broadcast(table), "hash").where(F.slice("w", F.col("at") + 1, K) == F.col("run"))
    return found.select("doc_id", "t", "label", "phrase", "template", "size", "place", "at")


def spans(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, share: float = SHARE
) -> DataFrame:
    """doc_id, t (digest of the text), label, phrase, template, first, last (words of the span, from 0), score."""
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), words(F.col("text")).alias("w"))
    rows = runs(phrases, notices)
    blocks = [_hits(texts, docs.sparkSession, rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
    hits = reduce(DataFrame.unionByName, blocks)
    diagonal = F.col("at") - F.col("place")
    band = F.floor(diagonal / SHIFT).cast("long")
    bands = F.when(F.col("phrase"), F.array(diagonal.cast("long"))).otherwise(F.array(band, band - 1))
    voted = hits.withColumn("band", F.explode(bands)).groupBy("doc_id", "t", "label", "phrase", "template", "size", "band")
    voted = voted.agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), (F.max("at") + K - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    judged = voted.withColumn("covered", covered).drop("places")
    score = 2.0 * F.col("covered") / (F.col("size") + F.col("last") - F.col("first") + 1)
    judged = judged.withColumn("score", F.when(F.col("phrase"), F.lit(1.0)).otherwise(score))
    whole = F.when(F.col("phrase"), F.col("covered") == F.col("size")).otherwise(
        (F.col("covered") >= share * F.col("size")) & (F.col("score") >= share)
    )
    # a band's neighbours see nearly the same span
    by = Window.partitionBy("doc_id", "t", "template").orderBy("band")
    before = (F.lag("band").over(by) == F.col("band") - 1) & (F.lag("score").over(by) >= F.col("score"))
    after = (F.lead("band").over(by) == F.col("band") + 1) & (F.lead("score").over(by) > F.col("score"))
    seen = ~F.col("phrase") & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    best = judged.where(whole).withColumn("seen", seen).where("not seen")
    return best.select("doc_id", "t", "label", "phrase", "template", "first", "last", "score")


def summary(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: numbers of words and phrases, labels and the best score."""
    found = spans(docs, **options)
    own = F.when(F.col("phrase"), F.col("first"))
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    per_text = found.groupBy(F.col("doc_id").alias("d"), "t").agg(
        F.count(own).alias("n_base"),
        F.min(own).cast("long").alias("first_word"),
        F.max(own).cast("long").alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    numbered = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    out = numbered.join(per_text, numbered["doc_id"].eqNullSafe(per_text["d"]) & (numbered["t"] == per_text["t"]), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
