"""Breaking-change rules between two Protobuf files, for many pairs of files at once.

Both sides are fact tables keyed by ``pair``; every rule returns (pair, issues) for the pairs that
have issues. Rules are set differences and intersections, so they are semi and anti joins on
(pair, scope, key). Reserved numbers stay ranges: they are compared by a sweep over range ends.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_plain
from .ordered import SPAN, running_sums

PLACE = ["pair", "scope"]


@dataclass(frozen=True)
class ProtoFacts:
    """Facts of one side. Columns besides ``pair``:

    fields: scope, name, tag, type, label; reserved_tags: scope, lo, hi (closed);
    reserved_names: scope, name; enums: scope, name, tag, ord; rpcs: service, rpc, signature.
    """

    fields: DataFrame
    reserved_tags: DataFrame
    reserved_names: DataFrame
    enums: DataFrame
    rpcs: DataFrame


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair").agg(F.count("*").alias("issues"))


def _sum(*parts: DataFrame) -> DataFrame:
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("pair").agg(F.sum("issues").alias("issues")).where("issues > 0")


def _ends(ranges: DataFrame) -> DataFrame:
    """+1 where a range begins, -1 after it ends."""
    return ranges.select(
        *PLACE,
        F.inline(
            F.array(
                F.struct(F.col("lo").cast("bigint").alias("point"), F.lit(1).alias("step")),
                F.struct((F.col("hi").cast("bigint") + 1).alias("point"), F.lit(-1).alias("step")),
            )
        ),
    )


def _tags_by_cover(tags: DataFrame, ranges: DataFrame, span: int) -> DataFrame:
    """``tags`` (pair, scope, tag, n) with ``covered``: is the tag inside any range of its scope."""
    events = _ends(ranges).withColumn("n", F.lit(0).cast("bigint")).unionByName(
        tags.select(*PLACE, F.col("tag").cast("bigint").alias("point"), F.lit(0).alias("step"), "n")
    )
    points = events.groupBy(*PLACE, "point").agg(F.sum("step").alias("step"), F.sum("n").alias("n"))
    swept = running_sums(points, PLACE, "point", {"before": F.col("step")}, span)
    return swept.where("n > 0").select(
        *PLACE, F.col("point").alias("tag"), "n", ((F.col("before") + F.col("step")) > 0).alias("covered")
    )


def using_reserved(before: ProtoFacts, after: ProtoFacts, span: int = SPAN) -> DataFrame:
    """R1: tags and names used after that were reserved before in the same message."""
    used_tags = after.fields.select(*PLACE, "tag").distinct().withColumn("n", F.lit(1).cast("bigint"))
    tags = _tags_by_cover(used_tags, before.reserved_tags, span).where("covered")
    names = (
        after.fields.select(*PLACE, "name").distinct().join(before.reserved_names, [*PLACE, "name"], "left_semi")
    )
    return _sum(_count(tags), _count(names))


def removing_reserved(before: ProtoFacts, after: ProtoFacts, span: int = SPAN) -> DataFrame:
    """R2: numbers and names reserved before and no longer reserved after.

    The number of lost numbers is a length: summing point * (open before it - open after it) over
    the range ends adds up the stretches that are open, here those reserved only before.
    """
    events = (
        _ends(before.reserved_tags)
        .withColumn("step_a", F.lit(0))
        .unionByName(_ends(after.reserved_tags).select(*PLACE, "point", F.lit(0).alias("step"), F.col("step").alias("step_a")))
    )
    points = events.groupBy(*PLACE, "point").agg(F.sum("step").alias("step"), F.sum("step_a").alias("step_a"))
    swept = running_sums(points, PLACE, "point", {"was_b": F.col("step"), "was_a": F.col("step_a")}, span)

    def lost(b: Column, a: Column) -> Column:
        return ((b > 0) & (a == 0)).cast("int")

    opened = lost(F.col("was_b"), F.col("was_a")) - lost(
        F.col("was_b") + F.col("step"), F.col("was_a") + F.col("step_a")
    )
    numbers = swept.groupBy("pair").agg(F.sum(F.col("point") * opened).alias("issues"))
    names = (
        before.reserved_names.select(*PLACE, "name")
        .distinct()
        .join(after.reserved_names, [*PLACE, "name"], "left_anti")
    )
    return _sum(numbers, _count(names))


def field_pairs(before: ProtoFacts, after: ProtoFacts) -> DataFrame:
    """Fields before, each with tag, type and label of the field of its name after; ``there`` is null if it is gone."""
    columns = ("tag", "type", "label")
    later = after.fields.select(*PLACE, "name", *[F.col(c).alias(f"{c}_after") for c in columns], F.lit(True).alias("there"))
    return before.fields.select(*PLACE, "name", *columns).join(later, [*PLACE, "name"], "left")


def removing_without_reserve(before: ProtoFacts, after: ProtoFacts, span: int = SPAN, fields: DataFrame | None = None) -> DataFrame:
    """R3: removed names that are not reserved, plus removed fields whose tag is neither reserved nor used."""
    fields = field_pairs(before, after) if fields is None else fields
    gone = fields.where("there is null").select(*PLACE, "name", "tag")
    names = gone.join(after.reserved_names, [*PLACE, "name"], "left_anti")
    unused = gone.join(after.fields, [*PLACE, "tag"], "left_anti").groupBy(*PLACE, "tag").agg(F.count("*").alias("n"))
    tags = _tags_by_cover(unused, after.reserved_tags, span).where(~F.col("covered"))
    return _sum(_count(names), tags.groupBy("pair").agg(F.sum("n").alias("issues")))


def changing_ids(before: ProtoFacts, after: ProtoFacts, fields: DataFrame | None = None) -> DataFrame:
    """R4: same name, other number; in messages and enums."""
    fields = field_pairs(before, after) if fields is None else fields
    later = after.enums.select(*PLACE, "name", F.col("tag").alias("tag_after"))
    enums = before.enums.select(*PLACE, "name", "tag").join(later, [*PLACE, "name"])
    return _sum(*[_count(both.where("tag <> tag_after")) for both in (fields, enums)])


def changing_types(before: ProtoFacts, after: ProtoFacts, fields: DataFrame | None = None) -> DataFrame:
    """R5: same name with another type, and again with another label."""
    both = (field_pairs(before, after) if fields is None else fields).where("there")
    flags = (F.col("type") != F.col("type_after")).cast("int") + (
        ~F.col("label").eqNullSafe(F.col("label_after"))
    ).cast("int")
    return both.groupBy("pair").agg(F.sum(flags).alias("issues")).where("issues > 0")


def enum_names_by_tag(enums: DataFrame, *keys: str) -> DataFrame:
    """Name per number of an enum; of aliases the last declared wins."""
    return enums.groupBy(*(keys or PLACE), "tag").agg(F.max_by("name", "ord").alias("name"))


def _names_by_tag(facts: ProtoFacts) -> DataFrame:
    return facts.fields.select(*PLACE, "tag", "name").unionByName(enum_names_by_tag(facts.enums))


def changing_names(before: ProtoFacts, after: ProtoFacts) -> DataFrame:
    """R6: numbers whose name differs or is gone, in scopes present on both sides."""
    a = _names_by_tag(after)
    return _count(
        _names_by_tag(before)
        .join(a.select(*PLACE).distinct(), PLACE, "left_semi")
        .join(a, [*PLACE, "tag", "name"], "left_anti")
    )


def removing_rpcs(before: ProtoFacts, after: ProtoFacts) -> DataFrame:
    """R7: RPCs that are gone, with or without their service."""
    return _count(before.rpcs.join(after.rpcs, ["pair", "service", "rpc"], "left_anti"))


def changing_signatures(before: ProtoFacts, after: ProtoFacts) -> DataFrame:
    """R8: RPCs with another signature or gone, in services present on both sides."""
    return _count(
        before.rpcs.join(after.rpcs.select("pair", "service").distinct(), ["pair", "service"], "left_semi").join(
            after.rpcs, ["pair", "service", "rpc", "signature"], "left_anti"
        )
    )


RULES = {
    "r1": using_reserved,
    "r2": removing_reserved,
    "r3": removing_without_reserve,
    "r4": changing_ids,
    "r5": changing_types,
    "r6": changing_names,
    "r7": removing_rpcs,
    "r8": changing_signatures,
}


def validate(pairs: DataFrame, before: ProtoFacts, after: ProtoFacts) -> DataFrame:
    """Total issues per pair and the verdict; ``pairs`` holds one row per pair."""
    # three rules look at the fields of one name on both sides: they are joined once
    fields = cut_plain(field_pairs(before, after))
    of_fields = ("r3", "r4", "r5")
    total = _sum(*[rule(before, after, **({"fields": fields} if name in of_fields else {})) for name, rule in RULES.items()])
    return pairs.join(total, "pair", "left").select(
        *pairs.columns,
        F.coalesce("issues", F.lit(0)).alias("issues"),
        F.col("issues").isNull().alias("compatible"),
    )


def rpc_signature(req: Column, req_stream: Column, resp: Column, resp_stream: Column) -> Column:
    return F.concat(req, F.lit(":"), req_stream.cast("string"), F.lit("->"), resp, F.lit(":"), resp_stream.cast("string"))


def map_fields(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("type").startswith("map<"))


def enum_keys(enums: DataFrame, *keys: str) -> DataFrame:
    """Used numbers and names of each enum, as text."""
    return enums.select(
        *(keys or PLACE), F.explode(F.array(F.col("tag").cast("string"), F.col("name"))).alias("used")
    ).distinct()
