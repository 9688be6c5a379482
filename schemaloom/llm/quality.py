"""Quality rules judged by host: rule failures per host, rates shrunk by a fitted beta prior, verdicts joined back.

A document always goes when it fails a base rule. A soft rule alone rejects nothing: a document that fails one
goes only where its whole host is bad at that rule, that is, where the host's shrunk failure rate is above
`host_rate`. Clean documents of bad hosts stay.

Built-in expressions only. The numbers of all documents are stored once (`cut`), hosts are aggregated with
map-side combine, the prior comes from two rows of sums, and the verdicts of hosts are a table of one row per host, which is joined back; its size on
storage lets the optimizer choose between a broadcast and a shuffle.

Defined results: a null or empty text has no words and fails the base rule; a null host is a host of its own;
repeated rows count once each; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.tables import words
from schemaloom.session import cut

#: Words of a window for repeated passages.
WINDOW = 8
#: Failure rate above which a host counts as bad at a rule.
HOST_RATE = 0.5
RULES = ("base", "symbols", "lines", "length")
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _joined(hashes: Column, gap: Column | int, size: Column) -> Column:
    """One hash of elements i and i + gap for each of the first `size` positions i."""
    left, right = F.slice(hashes, 1, size), F.slice(hashes, F.lit(gap) + 1, size)
    return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))


def with_numbers(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds the numbers of each text. Windows are compared by hash first and by their words where a hash repeats."""
    at = "__{}".format
    df = docs.withColumn(at("w"), words(F.col(text)))
    n = F.size(at("w"))
    starts, w, size = F.sequence(F.lit(0), n - window), F.col(at("w")), F.greatest(n - window + 1, F.lit(0))
    # hashes of 2, 4, ... words, each from two of half the length; two that overlap make up the whole window
    h, length = F.col(at("h")), 1
    df = df.withColumn(at("h"), F.transform(w, lambda x: F.xxhash64(x)))
    while 2 * length <= window:  # a column for each length: an expression used twice would be worked out twice
        df = df.withColumn(at("h"), _joined(h, length, F.greatest(n - 2 * length + 1, F.lit(0))))
        length *= 2
    hashes = _joined(h, window - length, size) if length < window else h
    passages = F.sort_array(
        F.transform(
            starts, lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + k) for k in range(window))).alias("k"), i.alias("i"))
        )
    )
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(at("w"), "")).cast("long"),
            "n_symbols": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long"),
            at("l"): lines,
            at("again"): F.when(n > window, F.size(F.array_distinct(hashes)) <= n - window).otherwise(False),
        }
    )
    df = df.withColumns(
        {
            "n_lines": F.size(at("l")).cast("long"),
            "n_dup_lines": (F.size(at("l")) - F.size(F.array_distinct(at("l")))).cast("long"),
            at("p"): F.when(F.col(at("again")), passages),
        }
    )
    p = F.col(at("p"))
    again = F.filter(
        p, lambda x, j: (F.get(p, j - 1)["k"].eqNullSafe(x["k"])) | (F.get(p, j + 1)["k"].eqNullSafe(x["k"]))
    )
    df = df.withColumn(at("s"), F.when(F.col(at("again")), F.sort_array(F.transform(again, lambda x: x["i"]))))
    s = F.col(at("s"))
    covered = F.aggregate(
        F.transform(s, lambda x, j: F.coalesce(F.least(F.get(s, j + 1) - x, F.lit(window)), F.lit(window))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return df.drop(*(at(x) for x in ("w", "h", "l", "again", "p", "s")))


def with_rules(df: DataFrame) -> DataFrame:
    """Adds <rule>_failed for each rule, from the numbers."""
    c = F.col
    return df.withColumns(
        {
            "base_failed": (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words")),
            "symbols_failed": 10 * c("n_symbols") > c("n_words"),
            "lines_failed": 100 * c("n_dup_lines") > 30 * c("n_lines"),
            "length_failed": (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")),
        }
    )


def host_verdicts(df: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """One row per host: host, n_docs, and for each rule its shrunk rate and whether the host is bad at it.

    The beta prior of a rule is fitted by moments: its mean is the rate over all documents, its variance that of
    the hosts' rates less what chance alone gives. Without such variance every host gets the mean.
    """
    hosts = cut(
        df.groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(f"{r}_failed").cast("long")).alias(f"k_{r}") for r in RULES)
        )
    )
    n, docs = F.col("n_docs"), F.sum("n_docs")
    all_docs, all_hosts, *means = hosts.agg(docs, F.count(F.lit(1)), *(F.sum(f"k_{r}") / docs for r in RULES)).first()
    if not all_hosts:
        means = [0.0] * len(RULES)
    spreads = [F.sum(n * F.pow(F.col(f"k_{r}") / n - m, F.lit(2.0))) / docs for r, m in zip(RULES, means, strict=True)]
    out = hosts
    for r, mean, spread in zip(RULES, means, hosts.agg(*spreads).first(), strict=True):
        chance = mean * (1 - mean)
        between = (spread or 0.0) - (chance * all_hosts / all_docs if all_docs else 0.0)
        weight = max(chance / between - 1, 0.001) if between > 1e-12 else 1e12
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + mean * weight) / (n + weight))
        out = out.withColumn(f"bad_{r}", F.col(f"rate_{r}") > host_rate)
    return out.select("host", "n_docs", *(f"{x}_{r}" for r in RULES for x in ("rate", "bad")))


def judge(numbered: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """Adds base_failed and kept to rows of with_numbers. The rows are stored once before hosts are aggregated."""
    ruled = cut(with_rules(numbered))
    hosts = cut(host_verdicts(ruled, host, host_rate)).select(
        F.col("host").alias("__host"), *(F.col(f"bad_{r}").alias(f"__{r}") for r in RULES)
    )
    bad = reduce(lambda a, b: a | b, (F.col(f"{r}_failed") & F.col(f"__{r}") for r in RULES))
    joined = ruled.join(hosts, F.col(host).eqNullSafe(F.col("__host")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))
    return joined.withColumn("kept", kept).drop("__host", *(f"__{r}" for r in RULES))
