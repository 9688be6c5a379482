"""Compatibility checks of proposed documents, dispatched by the dialect of what exists.

Requests are reduced to distinct cases first; a case is judged once and joined back to its requests.
Verdict null means the level is not supported for the dialect; reason says why a verdict is not a
plain yes or no.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, cut_plain
from .elements import Documents, audit, pair_verdicts
from .levels import effective_level
from .lookup import resolve_versions
from .protobuf_rules import validate
from .registration import live

# a proposed document comes after every registered version
AFTER_ALL = (1 << 31) - 1


def proto_pairs(document_pairs: DataFrame, facts) -> DataFrame:
    """Adds issues and compatible (rules R1 to R8) to distinct pairs (existing_id, proposed_id)."""
    # stored, because each of the ten fact tables joins to the pairs
    keyed = cut(
        document_pairs.select("existing_id", "proposed_id").distinct().withColumn(
            "pair", F.concat_ws(">", "existing_id", "proposed_id")
        )
    )
    return validate(keyed, facts.of_pairs(keyed, "existing_id"), facts.of_pairs(keyed, "proposed_id")).drop("pair")


def _by_dialect(existing: Column, proposed: Column, level: Column, avro_ok: Column, proto_ok: Column, same: Column):
    """(verdict, reason) by the dialect of the existing document."""
    open_level = ~level.isin(
        "BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD", "FORWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE"
    )
    forward = level.isin("FORWARD", "FORWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE")
    other = existing != proposed
    verdict = (
        F.when(existing.isNull(), True)
        .when(existing == "JSON_SCHEMA", same)
        .when(open_level, True)
        .when((existing == "PROTOBUF") & forward, F.lit(None))
        .when(other, False)
        .when(existing == "AVRO", avro_ok)
        .otherwise(proto_ok)
    )
    reason = (
        F.when(existing.isNull() | (existing == "JSON_SCHEMA") | open_level, F.lit(None))
        .when((existing == "PROTOBUF") & forward, "unsupported")
        .when(other, "dialect")
    )
    return verdict, reason


def _answered(requests: DataFrame, answers: DataFrame, *keys: str) -> DataFrame:
    """Requests with the answer of their case; one without a document or a subject says so in reason."""
    named = answers.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in answers.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    unread = F.when(F.col("proposed_id").isNull(), "unreadable").when(F.col("subject").isNull(), "no subject")
    found = requests.join(named, same, "left")
    return found.withColumn("is_compatible", F.when(unread.isNull(), F.col("is_compatible"))).withColumn(
        "reason", F.coalesce(unread, "reason")
    )


def _judged(typed: DataFrame, docs: Documents) -> DataFrame:
    """typed with backward, forward and full of its pairs of one dialect; null for others."""
    answers = None
    for rules in docs.rules:
        mine = typed.where((F.col("_old") == rules.dialect) & (F.col("_new") == rules.dialect))
        found = pair_verdicts(mine.select("existing_id", "proposed_id"), rules)
        answers = found if answers is None else answers.unionByName(found)
    return typed.join(answers, ["existing_id", "proposed_id"], "left")


def check_version(requests: DataFrame, versions: DataFrame, levels: DataFrame, schemas: DataFrame, docs: Documents) -> DataFrame:
    """Proposed documents against one named version each, at the level in force.

    ``requests``: seq, subject, token, proposed_id; ``schemas``: schema_id, dialect, raw, content.
    Adds is_compatible, reason and error_code (404 when there is no such version).
    """
    cases = requests.select("subject", "token", "proposed_id").distinct()
    found = effective_level(resolve_versions(cases, versions), levels).withColumnRenamed("schema_id", "existing_id")
    old = schemas.select(F.col("schema_id").alias("existing_id"), F.col("dialect").alias("_old"), F.col("content").alias("_content"))
    new = schemas.select(F.col("schema_id").alias("proposed_id"), F.col("dialect").alias("_new"), F.col("raw").alias("_raw"))
    # the cases are as many as requests at worst: stored without the texts, of which only their equality counts
    typed = cut_plain(
        found.join(old, "existing_id", "left").join(new, "proposed_id", "left")
        .withColumn("_same", F.col("_content") == F.col("_raw")).drop("_content", "_raw")
    )
    judged = _judged(typed, docs)
    level = F.col("level")
    avro_ok = (
        F.when(level.startswith("BACKWARD"), F.col("backward"))
        .when(level.startswith("FORWARD"), F.col("forward"))
        .otherwise(F.col("full"))
    )
    verdict, reason = _by_dialect(
        F.col("_old"), F.col("_new"), level, avro_ok, F.col("backward"), F.col("_same")
    )
    known = F.col("existing_id").isNotNull()
    answers = judged.select(
        "subject",
        "token",
        "proposed_id",
        F.when(known, verdict).alias("is_compatible"),
        F.when(known, reason).alias("reason"),
        F.when(~known, F.lit(404)).alias("error_code"),
    )
    return _answered(requests, answers, "subject", "token", "proposed_id").select(
        "seq", "subject", "is_compatible", "reason", "error_code"
    )


def check_before_registering(
    requests: DataFrame, versions: DataFrame, levels: DataFrame, schemas: DataFrame, docs: Documents
) -> DataFrame:
    """Proposed documents against what their subject holds, at the level in force.

    ``requests``: seq, subject, proposed_id. The dialect of the latest live version decides; plain
    levels compare with that version, transitive levels with all live versions, JSON Schema with
    the oldest. A subject without live versions accepts anything.
    """
    held = cut_plain(live(versions).join(schemas.select("schema_id", "dialect"), "schema_id").select("subject", "version", "schema_id", "dialect"))
    state = held.groupBy("subject").agg(
        F.max_by(F.struct("schema_id", "dialect"), "version").alias("_latest"),
        F.min_by("schema_id", "version").alias("_first"),
        F.count_distinct("dialect").alias("_dialects"),
    )
    oldest = schemas.select(F.col("schema_id").alias("_first"), F.col("content").alias("_oldest"))
    state = state.join(oldest, "_first")
    new = schemas.select(F.col("schema_id").alias("proposed_id"), F.col("dialect").alias("_new"), F.col("raw").alias("_raw"))
    cases = requests.select("subject", "proposed_id").distinct()
    typed = cut_plain(
        effective_level(cases, levels).join(state, "subject", "left").join(new, "proposed_id", "left")
        .withColumn("existing_id", F.col("_latest.schema_id")).withColumn("_old", F.col("_latest.dialect"))
        .withColumn("_same", F.col("_oldest") == F.col("_raw")).drop("_oldest", "_raw")
    )

    judged = _judged(typed, docs)
    for rules in docs.rules:
        # history of this dialect only: one that mixes dialects is refused at a transitive level
        asked = typed.where((F.col("_new") == rules.dialect) & F.col("level").endswith("_TRANSITIVE")).select(
            "subject", F.lit(AFTER_ALL).alias("at"), F.col("proposed_id").alias("schema_id")
        )
        past = held.where(F.col("dialect") == rules.dialect).select("subject", "version", "schema_id")
        found = audit(asked, past, rules).select(
            "subject", F.col("schema_id").alias("proposed_id"),
            (F.col("backward_issues") == 0).alias(f"_back_{rules.dialect}"), (F.col("forward_issues") == 0).alias(f"_ahead_{rules.dialect}"),
        )
        judged = judged.join(found, ["subject", "proposed_id"], "left")
    all_back, all_ahead = F.col("_back_AVRO"), F.col("_ahead_AVRO")
    level = F.col("level")
    avro_ok = (
        F.when(level == "BACKWARD", F.col("backward"))
        .when(level == "FORWARD", F.col("forward"))
        .when(level == "FULL", F.col("full"))
        .when(level == "BACKWARD_TRANSITIVE", all_back)
        .when(level == "FORWARD_TRANSITIVE", all_ahead)
        .otherwise(all_back & all_ahead)
    )
    proto_ok = F.when(level == "BACKWARD", F.col("backward")).otherwise(F.col("_back_PROTOBUF"))
    # a transitive level cannot compare with versions of another dialect
    mixed = level.endswith("_TRANSITIVE") & (F.col("_dialects") > 1)
    proposed = F.when(mixed, F.lit("mixed")).otherwise(F.col("_new"))
    verdict, reason = _by_dialect(
        F.col("_old"), proposed, level, avro_ok, proto_ok, F.col("_same")
    )
    answers = judged.select("subject", "proposed_id", verdict.alias("is_compatible"), reason.alias("reason"))
    return _answered(requests, answers, "subject", "proposed_id").select("seq", "subject", "is_compatible", "reason")
