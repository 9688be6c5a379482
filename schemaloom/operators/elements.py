"""Documents compared by what they consist of, for pairs, for whole histories and for a fold.

A document is a set of elements (place, signature): a field of a record, a message, a service. Whether a later
document breaks what an earlier one promised is decided place by place, from the two signatures that stand
there, one of which may be absent. So a dialect only has to judge distinct pairs of signatures that meet at
some place, each once, however many documents and subjects have them; the rest is counting:

* a pair of documents is broken if a place of either has a broken pair of signatures (``pair_verdicts``);
* a candidate against all earlier versions: running counts of signatures by place (``audit``);
* all documents of a subject against each other: sets of document numbers as bits, combined by place
  (``breaking_sets``), which a fold can test without holding any document.

No pairs of versions are formed. The work grows with elements, and at one place with the square of the distinct
signatures that a subject has had there.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dialects import WORD
from ..session import cut_plain
from .ordered import SPAN, number_rows, running_sums

#: The signature of what a document does not have.
ABSENT = ""


@dataclass(frozen=True)
class Rules:
    """How documents of one dialect are compared.

    ``place``: members (scope, schema_id) to rows (scope, schema_id, place, sig); documents of other dialects have
    none. ``broken``: rows with signatures (reader, writer), absent ones included, to those rows whose pair breaks;
    a pair is judged once. The reader is the later document's where a level looks backward.
    """

    dialect: str
    place: Callable[[DataFrame], DataFrame]
    broken: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Documents:
    """kinds: schema_id, dialect of every document; rules: of the dialects that have levels."""

    kinds: DataFrame
    rules: tuple[Rules, ...]


def _both_ways(rows: DataFrame, columns: list[str], one: str, other: str) -> DataFrame:
    """Rows with (way, reader, writer): backward ``one`` reads ``other``, forward it is read by it."""
    ways = [
        F.struct(F.lit(way).alias("way"), F.col(r).alias("reader"), F.col(w).alias("writer"))
        for way, r, w in (("backward", one, other), ("forward", other, one))
    ]
    return rows.select(*columns, F.inline(F.array(*ways)))


def _met(placed: DataFrame, rules: Rules) -> DataFrame:
    """scope, place, way, reader, writer: signatures of one place of one scope that break each other."""
    found = cut_plain(placed.select("scope", "place", "sig").distinct())
    both = found.withColumnRenamed("sig", "reader").join(found.withColumnRenamed("sig", "writer"), ["scope", "place"])
    alone = found.select("scope", "place", F.inline(F.array(
        F.struct(F.col("sig").alias("reader"), F.lit(ABSENT).alias("writer")),
        F.struct(F.lit(ABSENT).alias("reader"), F.col("sig").alias("writer")),
    )))
    broken = rules.broken(both.select("scope", "place", "reader", "writer").unionByName(alone))
    return cut_plain(_both_ways(broken, ["scope", "place"], "reader", "writer"))


def pair_verdicts(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Adds backward (proposed reads existing), forward and full to distinct pairs (existing_id, proposed_id)."""
    wanted = cut_plain(
        pairs.select("existing_id", "proposed_id").distinct().withColumn("scope", F.concat_ws(">", "existing_id", "proposed_id"))
    )
    members = wanted.select("scope", F.explode(F.array("existing_id", "proposed_id")).alias("schema_id")).distinct()
    placed = cut_plain(rules.place(members))

    def side(key: str, name: str) -> DataFrame:
        return placed.join(wanted.select("scope", F.col(key).alias("schema_id")), ["scope", "schema_id"]).select(
            "scope", "place", F.col("sig").alias(name)
        )

    beside = side("existing_id", "old").join(side("proposed_id", "new"), ["scope", "place"], "full")
    beside = beside.select("scope", *[F.coalesce(c, F.lit(ABSENT)).alias(c) for c in ("old", "new")])
    broken = rules.broken(cut_plain(_both_ways(beside, ["scope"], "new", "old")))
    failing = broken.groupBy("scope").agg(*[F.max(F.col("way") == way).alias(way) for way in ("backward", "forward")])
    ok = {c: ~F.coalesce(c, F.lit(False)) for c in ("backward", "forward")}
    judged = wanted.join(failing, "scope", "left").withColumns(ok)
    return judged.select("existing_id", "proposed_id", "backward", "forward", (F.col("backward") & F.col("forward")).alias("full"))


# ---- a candidate against all earlier versions ------------------------------------------------------


def seen_before(
    history: DataFrame, probes: DataFrame, keys: list[str], sums: dict[str, Column], span: int = SPAN
) -> DataFrame:
    """Per distinct (keys, at) of the probes, the sums over the history rows of the keys with version < at."""
    events = history.select(
        *keys, F.col("version").cast("bigint").alias("at"), *[e.cast("bigint").alias(n) for n, e in sums.items()]
    ).withColumn("_probe", F.lit(False))
    asked = probes.select(
        *keys, F.col("at").cast("bigint").alias("at"), *[F.lit(0).cast("bigint").alias(n) for n in sums]
    ).withColumn("_probe", F.lit(True))
    points = (
        events.unionByName(asked)
        .groupBy(*keys, "at")
        .agg(*[F.sum(n).alias(f"_{n}") for n in sums], F.bool_or("_probe").alias("_probe"))
    )
    swept = running_sums(points, keys, "at", {n: F.col(f"_{n}") for n in sums}, span)
    return swept.where("_probe").select(*keys, "at", *sums)


_WHO = ["scope", "at", "schema_id"]


def _issues(mine: DataFrame, theirs: DataFrame, wanted: DataFrame, total: DataFrame, breaking: DataFrame, name: str, span: int) -> DataFrame:
    """Broken places per candidate, summed over the earlier versions; the candidate is the reader of ``breaking``."""
    spot = ["scope", "place"]
    own = mine.select(*_WHO, "place", F.col("sig").alias("reader"))
    # signatures at the candidate's places that it breaks
    hit = own.join(breaking.where((F.col("reader") != ABSENT) & (F.col("writer") != ABSENT)), [*spot, "reader"])
    hit = hit.select(*_WHO, "place", F.col("writer").alias("sig"))
    counts = seen_before(theirs, hit, [*spot, "sig"], {"_n": F.lit(1)}, span)
    parts = [hit.join(counts, [*spot, "sig", "at"]).select(*_WHO, F.col("_n").alias("n"))]
    # places that the candidate needs and earlier versions may lack
    needs = breaking.where(F.col("writer") == ABSENT).select(*spot, "reader")
    needing = own.join(needs, [*spot, "reader"]).select(*_WHO, "place")
    there = seen_before(theirs, needing, spot, {"_n": F.lit(1)}, span)
    lacking = needing.join(there, [*spot, "at"]).join(total, ["scope", "at"])
    parts.append(lacking.select(*_WHO, (F.col("earlier") - F.col("_n")).alias("n")))
    # what earlier versions had and the candidate must not be without: all of it, less that at the candidate's places
    kept = theirs.join(breaking.where(F.col("reader") == ABSENT).select(*spot, F.col("writer").alias("sig")), [*spot, "sig"])
    every = seen_before(kept, wanted, ["scope"], {"_n": F.lit(1)}, span)
    parts.append(wanted.join(every, ["scope", "at"]).select(*_WHO, F.col("_n").alias("n")))
    here = seen_before(kept, own, spot, {"_n": F.lit(1)}, span)
    parts.append(own.join(here, [*spot, "at"]).select(*_WHO, (-F.col("_n")).alias("n")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*_WHO).agg(F.sum("n").alias(name))


def audit(candidates: DataFrame, history: DataFrame, rules: Rules, span: int = SPAN) -> DataFrame:
    """Adds earlier (number of versions compared), backward_issues and forward_issues.

    ``candidates`` has subject, at, schema_id; ``history`` has subject, version, schema_id. A candidate is held against
    the versions below ``at``. An issue is a place where one earlier version and the candidate disagree.
    """
    at = F.col("at").cast("bigint").alias("at")
    # one row per version: never broadcast, as a hashed row is six times its size in the file
    wanted = cut_plain(candidates.select(F.col("subject").alias("scope"), at, "schema_id").distinct()).hint("merge")
    past = cut_plain(history.select(F.col("subject").alias("scope"), "version", "schema_id")).hint("merge")
    members = wanted.select("scope", "schema_id").unionByName(past.select("scope", "schema_id")).distinct()
    placed = cut_plain(rules.place(members)).hint("merge")
    breaking = _met(placed, rules)
    mine = wanted.join(placed, ["scope", "schema_id"])
    theirs = past.join(placed, ["scope", "schema_id"]).select("scope", "version", "place", "sig")
    total = seen_before(past, wanted, ["scope"], {"earlier": F.lit(1)}, span)
    out = wanted.join(total, ["scope", "at"])
    for way in ("backward", "forward"):
        pairs = breaking.where(F.col("way") == way).drop("way")
        out = out.join(_issues(mine, theirs, wanted, total, pairs, f"{way}_issues", span), _WHO, "left")
    issues = [F.coalesce(c, F.lit(0)).alias(c) for c in ("backward_issues", "forward_issues")]
    return out.select(F.col("scope").alias("subject"), "at", "schema_id", "earlier", *issues)


def as_candidates(live_versions: DataFrame) -> DataFrame:
    """Every version as a candidate against the versions before it."""
    return live_versions.select("subject", F.col("version").alias("at"), "schema_id")


# ---- sets of documents -----------------------------------------------------------------------------


def _or(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def breaking_sets(members: DataFrame, rules: Rules) -> DataFrame:
    """scope, schema_id, backward, forward: sets of the documents of its scope that a document breaks with.

    ``members`` has scope, schema_id and n, a number of the document within the scope; documents of the rules' dialect only.
    """
    members = cut_plain(members.select("scope", "schema_id", "n"))
    placed = cut_plain(rules.place(members.select("scope", "schema_id")))
    breaking = _met(placed, rules)
    spot, here = ["scope", "place"], ["scope", "place", "way"]
    numbered = members.withColumns({"word": F.expr(f"n div {WORD}"), "bits": F.expr(f"shiftleft(1L, cast(n % {WORD} as int))")})
    having = placed.join(numbered, ["scope", "schema_id"])
    by_sig = cut_plain(_or(having, *spot, "sig"))
    hit = breaking.where((F.col("reader") != ABSENT) & (F.col("writer") != ABSENT)).join(
        by_sig.withColumnRenamed("sig", "writer"), [*spot, "writer"]
    )
    # documents without a place that the reader needs
    needs = breaking.where(F.col("writer") == ABSENT).select(*here, "reader")
    there = _or(by_sig, *spot).withColumnRenamed("bits", "there")
    lacking = needs.join(_or(numbered, "scope"), "scope").join(there, [*spot, "word"], "left")
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("there", F.lit(0).cast("bigint"))))
    by_reader = hit.select(*here, "reader", "word", "bits").unionByName(lacking.select(*here, "reader", "word", left.alias("bits")))
    mine = placed.join(_or(by_reader, *here, "reader").withColumnRenamed("reader", "sig"), [*spot, "sig"])
    # documents with a place that the reader must not be without
    kept = breaking.where(F.col("reader") == ABSENT).select(*here, F.col("writer").alias("sig")).join(by_sig, [*spot, "sig"])
    without = members.select("scope", "schema_id").join(_or(kept, *here), "scope").join(
        placed.select("scope", "schema_id", "place"), ["scope", "schema_id", "place"], "left_anti"
    )
    columns = ["scope", "schema_id", "way", "word", "bits"]
    all_ = _or(mine.select(columns).unionByName(without.select(columns)).where("bits <> 0"), "scope", "schema_id", "way")

    def dense(way: str) -> Column:
        """One word for each 64 documents of a subject; null for the empty set."""
        words = F.map_from_entries(F.collect_list(F.when(F.col("way") == way, F.struct("word", "bits"))))
        last = F.coalesce(F.array_max(F.map_keys(words)), F.lit(-1).cast("bigint"))
        filled = F.transform(
            F.sequence(F.lit(0).cast("bigint"), last), lambda w: F.coalesce(F.try_element_at(words, w), F.lit(0).cast("bigint"))
        )
        return F.when(last >= 0, filled).alias(way)

    return all_.groupBy("scope", "schema_id").agg(dense("backward"), dense("forward"))


def numbered_sets(members: DataFrame, docs: Documents) -> DataFrame:
    """subject, schema_id, n, dialect, backward, forward for distinct members (subject, schema_id).

    n numbers the documents of a subject; the sets hold the numbers of those of the same dialect that break each other.
    """
    known = members.select("subject", "schema_id").distinct().join(docs.kinds.select("schema_id", "dialect"), "schema_id")
    numbered = cut_plain(number_rows(known, ["subject"], "schema_id", "n").withColumn("n", F.col("n").cast("bigint")))
    kind = "array<bigint>"
    sets = None
    for rules in docs.rules:
        mine = numbered.where(F.col("dialect") == rules.dialect)
        made = breaking_sets(mine.select(F.col("subject").alias("scope"), "schema_id", "n"), rules)
        made = made.select(F.col("scope").alias("subject"), "schema_id", F.col("backward").cast(kind), F.col("forward").cast(kind))
        sets = made if sets is None else sets.unionByName(made)
    if sets is None:
        return numbered.withColumns({c: F.lit(None).cast(kind) for c in ("backward", "forward")})
    return numbered.join(sets, ["subject", "schema_id"], "left")
