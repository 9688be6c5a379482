"""Elements and rules of the dialects, for ``operators.elements``.

Avro: a place is a field name of a root record, a signature is that field as a record of its own: type with all
definitions it refers to, aliases, whether there is a default. Names that aliases connect within a scope are one place with
several fields. The empty place holds the root: its names, or all of it where a scope has roots that are no records.
Protobuf: a place is a message, an enum or a service, a signature all that it holds; one that is absent holds nothing.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.avro import readable
from ..functions.avro_text import element_nodes
from ..session import cut, spread
from .avro_nested import nested_pairs
from .elements import ABSENT, Rules
from .protobuf_rules import ProtoFacts, validate

ROOT = ""
#: Signatures are digests but for fields of primitive types, which say all there is to know.
_DIGEST = 64


def _record(fields: Column) -> Column:
    return F.concat(F.lit('{"type":"record","name":"__element","fields":['), F.array_join(fields, ","), F.lit("]}"))


def _field(name: Column, type_: Column, aliases: Column | None, has_default: Column) -> Column:
    known = F.lit("") if aliases is None else F.coalesce(F.concat(F.lit(',"aliases":'), F.to_json(aliases)), F.lit(""))
    default = F.when(has_default, ',"default":null').otherwise("")
    return F.concat(F.lit('{"name":"'), name, F.lit('","type":'), type_, known, default, F.lit("}"))


def _simple_sig(type_: Column, has_default: Column) -> Column:
    return F.concat(type_, F.when(has_default, "=").otherwise(""))


def flat_avro(fields: DataFrame) -> Rules:
    """Rules for records of one name with fields (schema_id, name, type, has_default) of primitive types."""
    facts = cut(fields.select("schema_id", F.col("name").alias("place"), _simple_sig(F.col("type"), F.col("has_default")).alias("sig")))
    return Rules("AVRO", lambda members: members.join(facts, "schema_id").select("scope", "schema_id", "place", "sig"), _simple_broken)


def _type_of(sig: Column) -> Column:
    return F.rtrim(sig, F.lit("="))


def _simple_broken(pairs: DataFrame) -> DataFrame:
    reader, writer = F.col("reader"), F.col("writer")
    lost = (writer == ABSENT) & ~reader.endswith("=")
    return pairs.where((reader != ABSENT) & (lost | (writer != ABSENT) & ~readable(_type_of(reader), _type_of(writer))))


def avro(nodes: DataFrame) -> Rules:
    """Rules for documents of any type, given as node rows (schema_id, path, ..., alone)."""
    kept = cut(nodes.where("path = '' or role = 'field' and parent_path = ''").select(
        "schema_id", "path", "kind", "type", "name", "aliases", "type_aliases", "has_default", "alone"
    ))
    texts: list[DataFrame] = []

    def place(members: DataFrame) -> DataFrame:
        rows = members.join(kept, "schema_id")
        roots = rows.where("path = ''")
        mixed = roots.where("kind <> 'record'").select("scope").distinct().withColumn("whole", F.lit(True))
        roots = roots.join(mixed, "scope", "left")
        named = F.to_json(F.struct(
            F.lit("record").alias("type"), F.regexp_extract("type", r"([^.]*)$", 1).alias("name"),
            F.regexp_extract("type", r"^(.*)\.[^.]*$", 1).alias("namespace"), F.col("type_aliases").alias("aliases"),
            F.array().cast("array<string>").alias("fields"),
        ))
        root_text = F.when(F.col("whole"), F.col("alone")).otherwise(named)
        none = F.lit(None).cast("string")
        top = roots.select(
            "scope", "schema_id", F.lit(ROOT).alias("place"), F.concat(F.lit("/"), F.sha2(root_text, 256)).alias("sig"), root_text.alias("text")
        )
        fields = rows.where("path <> ''").join(mixed, "scope", "left_anti")
        connected = _connected(fields)
        if connected is None:
            lone, several = fields, None
        else:
            lone, several = fields.join(connected, ["scope", "name"], "left_anti"), fields.join(connected, ["scope", "name"])
        # a field that no alias connects is compared whatever its name
        text = _record(F.array(_field(F.lit("f"), F.col("alone"), None, F.col("has_default"))))
        simple = F.when(F.col("kind") == "primitive", _simple_sig(F.col("type"), F.col("has_default")))
        below = lone.select(
            "scope", "schema_id", F.col("name").alias("place"),
            F.coalesce(simple, F.sha2(text, 256)).alias("sig"), F.when(simple.isNull(), text).otherwise(none).alias("text"),
        )
        parts = top.unionByName(below)
        if several is not None:
            field = _field(F.col("name"), F.col("alone"), F.col("aliases"), F.col("has_default"))
            grouped = several.withColumn("field", field).groupBy("scope", "schema_id", "place")
            text = _record(F.col("fields"))
            parts = parts.unionByName(
                grouped.agg(F.array_sort(F.collect_list("field")).alias("fields"))
                .select("scope", "schema_id", "place", F.sha2(text, 256).alias("sig"), text.alias("text"))
            )
        found = cut(parts)
        texts.append(found.where("text is not null").select("sig", "text"))
        return found.select("scope", "schema_id", "place", "sig")

    def broken(pairs: DataFrame) -> DataFrame:
        digest = lambda c: F.length(c) >= _DIGEST
        # equal signatures read each other, nothing is lost by a reader without a place, and every document has a root
        met = pairs.where((F.col("reader") != F.col("writer")) & (F.col("reader") != ABSENT))
        met = met.where(~(F.col("reader").startswith("/") & (F.col("writer") == ABSENT)))
        easy = _simple_broken(met.where(~digest("reader") & ~digest("writer")))
        hard = cut(met.where(digest("reader") | digest("writer")))
        asked = cut(hard.select("reader", "writer").distinct())
        return easy if asked.isEmpty() else easy.unionByName(hard.join(_judged(asked, texts), ["reader", "writer"], "left_semi").select(easy.columns))

    return Rules("AVRO", place, broken)


def _connected(fields: DataFrame) -> DataFrame | None:
    """scope, name, place: names that aliases connect, each with the least of them; None if there are no aliases."""
    edges = cut(fields.select("scope", "name", F.explode("aliases").alias("other")).distinct())
    if edges.isEmpty():
        return None
    edges = cut(edges.unionByName(edges.select("scope", F.col("other").alias("name"), F.col("name").alias("other"))).distinct())
    now = cut(edges.groupBy("scope", "name").agg(F.least("name", F.min("other")).alias("place")))
    while True:  # as many rounds as names in the longest chain
        beside = edges.join(now.select("scope", F.col("name").alias("other"), F.col("place").alias("next")), ["scope", "other"])
        least = beside.groupBy("scope", "name").agg(F.min("next").alias("next"))
        grown = cut(now.join(least, ["scope", "name"]).withColumn("next", F.least("place", "next")))
        now = grown.select("scope", "name", F.col("next").alias("place"))
        if grown.where("next < place").isEmpty():
            return now


def _judged(pairs: DataFrame, texts: list[DataFrame]) -> DataFrame:
    """Those of the pairs that break, by the rules on whole types."""
    known = texts[0]
    for more in texts[1:]:
        known = known.unionByName(more)
    sigs = pairs.select(F.explode(F.array("reader", "writer")).alias("sig")).distinct()
    simple = F.concat(F.lit('"'), F.rtrim("sig", F.lit("=")), F.lit('"'))
    field = F.array(_field(F.lit("f"), simple, None, F.col("sig").endswith("=")))
    made = F.when(F.col("sig") == ABSENT, _record(F.array().cast("array<string>"))).otherwise(_record(field))
    short = sigs.where(F.length("sig") < _DIGEST).select("sig", made.alias("text"))
    long = sigs.join(known, "sig").dropDuplicates(["sig"]).select("sig", "text")
    read = spread(short.unionByName(long), "sig").select(F.col("sig").alias("schema_id"), element_nodes(F.col("text")).alias("nodes"))
    judged = nested_pairs(
        pairs.select(F.col("reader").alias("reader_id"), F.col("writer").alias("writer_id")), cut(read).select("schema_id", F.inline("nodes"))
    )
    return judged.where("not compatible").select(F.col("reader_id").alias("reader"), F.col("writer_id").alias("writer"))


def protobuf(facts) -> Rules:
    """Rules for Protobuf files, given as document facts keyed by schema_id."""
    message, service = F.concat(F.lit("m:"), "scope").alias("place"), F.concat(F.lit("s:"), "service").alias("place")

    def lines(rows: DataFrame, kind: str, place: Column, *columns: str) -> DataFrame:
        return rows.select("schema_id", place, F.to_json(F.struct(F.lit(kind).alias("kind"), *columns)).alias("line"))

    # of an enum's aliases it counts which one comes last, not where
    last = facts.enums.groupBy("schema_id", "scope", "tag").agg(F.max_by("name", "ord").alias("name"))
    parts = [
        lines(facts.fields, "field", message, "name", "tag", "type", F.coalesce("label", F.lit("")).alias("label")),
        lines(facts.reserved_tags, "range", message, "lo", "hi"),
        lines(facts.reserved_names, "name", message, "name"),
        lines(facts.enums, "constant", message, "name", "tag"),
        lines(last, "last", message, "name", "tag"),
        lines(facts.rpcs, "rpc", service, "rpc", "signature"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # one group is one message, enum or service of one document
    sig = F.sha2(F.array_join(F.array_sort(F.collect_set("line")), "\n"), 256).alias("sig")
    sigs = cut(rows.groupBy("schema_id", "place").agg(sig))
    first = sigs.groupBy("sig").agg(F.min(F.struct("schema_id", "place")).alias("f")).select("sig", "f.*")

    def standing(pairs: DataFrame, side: str) -> ProtoFacts:
        """The facts of the signatures of one side."""
        chosen = pairs.select("pair", F.col(side).alias("sig")).join(first, "sig").select("pair", "schema_id", "place")

        def take(table: DataFrame, place: Column, *columns: str) -> DataFrame:
            return table.withColumn("place", place).join(chosen, ["schema_id", "place"]).select("pair", *columns)

        return ProtoFacts(
            take(facts.fields, message, "scope", "name", "tag", "type", "label"),
            take(facts.reserved_tags, message, "scope", "lo", "hi"),
            take(facts.reserved_names, message, "scope", "name"),
            take(facts.enums, message, "scope", "name", "tag", "ord"),
            take(facts.rpcs, service, "service", "rpc", "signature"),
        )

    def broken(pairs: DataFrame) -> DataFrame:
        met = pairs.where(F.col("writer") != ABSENT)
        asked = met.select("reader", "writer").distinct().withColumn("pair", F.concat_ws(">", "reader", "writer"))
        asked = cut(asked)
        judged = validate(asked, standing(asked, "writer"), standing(asked, "reader")).where("not compatible")
        return met.join(judged.select("reader", "writer"), ["reader", "writer"], "left_semi").select(pairs.columns)

    return Rules("PROTOBUF", lambda members: members.join(sigs, "schema_id").select("scope", "schema_id", "place", "sig"), broken)
