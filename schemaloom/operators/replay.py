"""Replay of a registration log.

Whether a registration is accepted depends on what the subject held at that moment, so replay is a
fold over the operations of a subject in sequence order. It is a native ``aggregate`` over an array,
and the array is bounded: a subject takes part with at most ``fold_ops`` operations per round, and
the live versions it holds are carried to its next round. Only subjects with more operations than
that need a second round. Levels are attached beforehand by bounded as-of lookups, so CONFIG
operations never enter the fold, and runs of the same registration are folded once.

Log columns: seq, subject, op (REGISTER, DELETE, DELETE_SUBJECT, CONFIG, GLOBAL), schema_id,
level_set, delete_version (0 = latest); optionally exact, whether the registered text was already in
canonical form (true if absent).

The fold holds no documents: a document is its number within the subject, and an operation carries the set
of numbers that its document breaks with, worked out beforehand (``elements.numbered_sets``).
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dialects import ENTRY, verdict
from ..session import PLAIN, cut_plain, new_folder
from .elements import Documents, numbered_sets
from .levels import with_level_in_force
from .ordered import SPAN, number_rows, slot_keys

FOLD_OPS = 4096

_STATE = f"array<{ENTRY}>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def _event(op: Column, status: str, schema_id: Column, versions: Column) -> Column:
    return F.struct(
        op["seq"].alias("seq"),
        op["op"].alias("op"),
        F.lit(status).alias("status"),
        schema_id.cast("int").alias("schema_id"),
        versions.cast("array<int>").alias("versions"),
    )


def _step() -> Callable[[Column, Column], Column]:
    """One operation on the state (top: highest version given so far; live; events)."""
    none = F.lit(None)

    def state(top: Column, live: Column, acc: Column, event: Column) -> Column:
        return F.struct(
            top.cast("int").alias("top"),
            live.alias("live"),
            F.concat(acc["events"], F.array(event)).alias("events"),
        )

    def register(acc: Column, op: Column) -> Column:
        live, schema_id = acc["live"], op["schema_id"]
        accepted = (F.size(live) == 0) | F.coalesce(verdict(op["level"], live, op), F.lit(False))
        facts = F.struct(
            accepted.alias("accepted"),
            F.filter(live, lambda e: e["schema_id"] == schema_id)["version"].alias("places"),
        )

        def decide(fact: Column) -> Column:
            entry = F.struct(
                (acc["top"] + 1).cast("int").alias("version"), schema_id.alias("schema_id"),
                op["n"].alias("n"), op["dialect"].alias("dialect"),
            )
            return (
                F.when(
                    ~fact["accepted"],
                    state(acc["top"], live, acc, _event(op, "refused", none, F.array())),
                )
                .when(
                    F.size(fact["places"]) > 0,
                    state(acc["top"], live, acc, _event(op, "present", schema_id, fact["places"])),
                )
                .otherwise(
                    state(
                        acc["top"] + 1,
                        F.concat(live, F.array(entry)),
                        acc,
                        _event(op, "added", schema_id, F.array(acc["top"] + 1)),
                    )
                )
            )

        return _let(facts, decide)

    def delete(acc: Column, op: Column) -> Column:
        live = acc["live"]
        wanted = F.when(op["delete_version"] == 0, F.try_element_at(live, F.lit(-1))["version"]).otherwise(
            op["delete_version"]
        )

        def decide(number: Column) -> Column:
            rest = F.filter(live, lambda e: e["version"] != number)
            return F.when(
                F.exists(live, lambda e: e["version"] == number),
                state(acc["top"], rest, acc, _event(op, "deleted", none, F.array(number))),
            ).otherwise(state(acc["top"], live, acc, _event(op, "not_found", none, F.array())))

        return _let(wanted, decide)

    def delete_subject(acc: Column, op: Column) -> Column:
        live = acc["live"]
        known = (acc["top"] > 0) | op["own_level"].isNotNull()
        return F.when(
            known,
            state(acc["top"], F.slice(live, 1, 0), acc, _event(op, "deleted", none, F.transform(live, lambda e: e["version"]))),
        ).otherwise(state(acc["top"], live, acc, _event(op, "not_found", none, F.array())))

    def step(acc: Column, op: Column) -> Column:
        return (
            F.when(op["op"] == "REGISTER", register(acc, op))
            .when(op["op"] == "DELETE", delete(acc, op))
            .otherwise(delete_subject(acc, op))
        )

    return step


def prepare(log: DataFrame, kinds: DataFrame, span: int = SPAN) -> DataFrame:
    """Attach the level in force, drop level changes, mark heads of runs.

    A registration that directly follows the same registration of its subject at the same level
    leaves the state alone and has the same outcome: if the first was refused nothing changed, and
    if it was accepted an Avro document can read itself (the others need not accept themselves).
    Runs are found inside a slot only; a run that crosses a slot border just has two heads.
    """
    given = log if "exact" in log.columns else log.withColumn("exact", F.lit(True))
    levelled = with_level_in_force(given, span).where(F.col("op").isin("REGISTER", "DELETE", "DELETE_SUBJECT"))
    levelled = levelled.join(kinds.select("schema_id", (F.col("dialect") == "AVRO").alias("_steady")), "schema_id", "left")
    same_slot = W.partitionBy(*slot_keys(["subject"], "seq", span)).orderBy("seq")
    what = F.struct("op", "schema_id", "level")
    repeated = (F.col("op") == "REGISTER") & F.lag(what).over(same_slot).eqNullSafe(what) & F.col("_steady")
    heads = levelled.withColumn("_repeated", F.coalesce(repeated, F.lit(False)))
    head_seq = F.last(F.when(~F.col("_repeated"), F.col("seq")), ignorenulls=True).over(
        same_slot.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return heads.withColumn("head_seq", head_seq).select(
        "subject", "seq", "head_seq", "op", "schema_id", "level", "own_level", "delete_version", "exact"
    )


def _fold(heads: DataFrame, carried: DataFrame | None) -> DataFrame:
    """One round: the given operations of each subject on top of its carried state."""
    empty = F.array().cast(_STATE)
    # dealt out by subject whatever the plan above has established
    parts = heads.repartition("subject").groupBy("subject").agg(
        F.sort_array(
            F.collect_list(F.struct(
                "seq", "op", "schema_id", "level", "own_level", "delete_version", "exact", "n", "dialect", "backward", "forward"
            ))
        ).alias("ops")
    )
    if carried is not None:
        parts = parts.join(carried.select("subject", "top", "live"), "subject", "left")
    else:
        parts = parts.select("*", F.lit(0).alias("top"), empty.alias("live"))
    events_type = "array<struct<seq:bigint,op:string,status:string,schema_id:int,versions:array<int>>>"
    start = F.struct(
        F.coalesce("top", F.lit(0)).cast("int").alias("top"),
        F.coalesce("live", empty).alias("live"),
        F.array().cast(events_type).alias("events"),
    )
    folded = parts.select("subject", F.aggregate("ops", start, _step()).alias("s"))
    return folded.select("subject", "s.top", "s.live", "s.events")


def replay_events(
    log: DataFrame,
    docs: Documents,
    past: DataFrame | None = None,
    repeats: bool = True,
    fold_ops: int = FOLD_OPS,
    span: int = SPAN,
) -> DataFrame:
    """Outcome of every REGISTER, DELETE and DELETE_SUBJECT: subject, seq, op, status, schema_id, versions.

    status: added, present, refused, deleted, not_found; versions: the numbers it concerns.
    ``past`` is a version table to go on from. ``repeats=False`` leaves out the repeats of a run, which never
    change the state: enough for version tables.
    """
    prepared = cut_plain(prepare(log, docs.kinds, span))
    # documents that may stand beside each other in a subject, by number; a document registered again is one
    members = prepared.where("op = 'REGISTER'").select("subject", "schema_id")
    if past is not None:
        past = cut_plain(past)
        members = members.unionByName(past.where("not deleted").select("subject", "schema_id"))
    sets = cut_plain(numbered_sets(members, docs))
    heads = prepared.where("seq = head_seq").drop("head_seq").join(sets, ["subject", "schema_id"], "left")
    carried = None if past is None else carried_state(past, sets)
    events = _fold_rounds(heads, carried, fold_ops, span)
    return _spread_runs(prepared, events) if repeats else events


def _fold_rounds(heads, carried, fold_ops, span) -> DataFrame:
    """Fold round by round; each round writes its events and the state it leaves below one folder."""
    spark = heads.sparkSession
    numbered = number_rows(heads, ["subject"], "seq", "_pos", span).withColumn(
        "_round", F.expr(f"(_pos - 1) div {int(fold_ops)}")
    )
    # in round order, so that the scan of a round skips the files of the others
    placed = cut_plain(numbered.drop("_pos").repartitionByRange("_round", "subject", "seq").sortWithinPartitions("_round"))
    rounds = placed.agg(F.max("_round")).first()[0]
    folder = new_folder(spark)
    schema = None
    for number in range(int(rounds or 0) + 1):
        part = _fold(placed.where(F.col("_round") == number).drop("_round"), carried)
        schema = part.schema
        part.write.options(**PLAIN).parquet(f"{folder}/round={number}")
        carried = spark.read.schema(schema).parquet(f"{folder}/round={number}").select("subject", "top", "live")
    return spark.read.schema(schema).parquet(folder).select("subject", F.inline("events"))


def _spread_runs(prepared: DataFrame, events: DataFrame) -> DataFrame:
    """Give the repeats of a run the outcome of its head; they find the schema present."""
    repeats = prepared.where("seq <> head_seq").select("subject", "seq", F.col("head_seq").alias("_head"))
    copied = repeats.join(events.withColumnRenamed("seq", "_head"), ["subject", "_head"]).select(
        "subject",
        "seq",
        "op",
        F.when(F.col("status") == "added", F.lit("present")).otherwise(F.col("status")).alias("status"),
        "schema_id",
        "versions",
    )
    return events.unionByName(copied)


def versions_of(events: DataFrame) -> DataFrame:
    """Version table of an event table: subject, version, schema_id, deleted."""
    return (
        events.where(F.col("status").isin("added", "deleted"))
        .select("subject", "status", "schema_id", F.explode("versions").alias("version"))
        .groupBy("subject", "version")
        .agg(F.max("schema_id").alias("schema_id"), F.bool_or(F.col("status") == "deleted").alias("deleted"))
    )


def carried_state(versions: DataFrame, sets: DataFrame) -> DataFrame:
    """The state to continue from, out of a version table and numbered documents: subject, top, live."""
    entry = F.when(~F.col("deleted"), F.struct("version", "schema_id", "n", "dialect"))
    return (
        versions.join(sets.select("subject", "schema_id", "n", "dialect"), ["subject", "schema_id"], "left")
        .groupBy("subject")
        .agg(F.max("version").alias("top"), F.sort_array(F.collect_list(entry)).alias("live"))
    )
