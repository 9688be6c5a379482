"""Protobuf documents to fact tables, one row per element, keyed by schema_id."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import protobuf_text as pt
from ..functions.once import with_computed
from ..operators.protobuf_rules import ProtoFacts, rpc_signature
from ..session import cut, spread


@dataclass(frozen=True)
class DocumentFacts:
    """fields: scope, name, tag, type, label, oneof; reserved_tags: scope, lo, hi;
    reserved_names: scope, name; enums: scope, name, tag, ord;
    rpcs: service, rpc, req, req_stream, resp, resp_stream, signature.
    """

    fields: DataFrame
    reserved_tags: DataFrame
    reserved_names: DataFrame
    enums: DataFrame
    rpcs: DataFrame

    def of_pairs(self, pairs: DataFrame, side: str) -> ProtoFacts:
        """Facts of one side of document pairs: ``pairs`` has pair and the schema ids of the sides."""
        chosen = pairs.select("pair", F.col(side).alias("schema_id"))

        def take(facts: DataFrame, *columns: str) -> DataFrame:
            return facts.join(chosen, "schema_id").select("pair", *columns)

        return ProtoFacts(
            take(self.fields, "scope", "name", "tag", "type", "label"),
            take(self.reserved_tags, "scope", "lo", "hi"),
            take(self.reserved_names, "scope", "name"),
            take(self.enums, "scope", "name", "tag", "ord"),
            take(self.rpcs, "service", "rpc", "signature"),
        )


def parse(documents: DataFrame, column: str) -> DataFrame:
    """Adds proto_ok (is the text a Protobuf file) and proto_out (its statements with scopes)."""
    texts = with_computed(documents, "_text", pt.squeeze(F.col(column)))
    nested = with_computed(texts, "_nested", pt.nest(pt.statements(F.col("_text"))))
    whole = F.col("_nested.ok") & (F.size("_nested.open") == 0) & (pt.rest(F.col("_text")) == "")
    return (
        with_computed(nested, "proto_ok", whole)
        .withColumn("proto_out", F.when(F.col("proto_ok"), F.col("_nested.out")))
        .drop("_text", "_nested")
    )


def canonical(documents: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the canonical text of documents known to be Protobuf."""
    return with_computed(documents, out, pt.canonical(pt.statements(pt.squeeze(F.col(column)))))


def flatten(documents: DataFrame) -> DocumentFacts:
    """Facts of distinct documents: schema_id, content; texts that are not Protobuf give none.

    The statements are stored: a document is read once, however many facts and rules use it.
    """
    return facts_of(parse(spread(documents.select("schema_id", "content"), "schema_id"), "content").where("proto_ok"))


def facts_of(parsed: DataFrame) -> DocumentFacts:
    """Facts of documents whose statements are known (schema_id, proto_out)."""
    rows = cut(
        parsed.select("schema_id", F.posexplode("proto_out").alias("ord", "s"))
        .select("schema_id", "ord", "s.kind", "s.block", "s.scope", "s.oneof", "s.text")
    )
    text = F.col("text")
    # fields of extensions belong to no message of this file
    in_message = ~F.col("scope").startswith("extend ")
    fields = rows.where((F.col("kind") == "field") & in_message).select(
        "schema_id", "scope",
        pt.field_name(text).alias("name"), pt.field_tag(text).alias("tag"), pt.field_type(text).alias("type"),
        pt.field_label(text).alias("label"), "oneof",
    )
    # reservations of enums are not part of the facts: rules R1 to R3 look at messages only
    enums = rows.where("kind = 'constant'")
    reserved = rows.where("kind = 'reserved' and block <> 'enum'")
    rpcs = rows.where("kind = 'rpc'").select(
        "schema_id", F.col("scope").alias("service"), pt.rpc_part(text, 1).alias("rpc"),
        pt.rpc_part(text, 3).alias("req"), (pt.rpc_part(text, 2) != "").alias("req_stream"),
        pt.rpc_part(text, 5).alias("resp"), (pt.rpc_part(text, 4) != "").alias("resp_stream"),
    )
    return DocumentFacts(
        fields,
        reserved.select("schema_id", "scope", F.inline(pt.reserved_ranges(text))),
        reserved.select("schema_id", "scope", F.explode(pt.reserved_names(text)).alias("name")),
        enums.select("schema_id", "scope", pt.constant_name(text).alias("name"), pt.constant_tag(text).alias("tag"), "ord"),
        rpcs.withColumn(
            "signature",
            rpc_signature(F.col("req"), F.col("req_stream"), F.col("resp"), F.col("resp_stream")),
        ),
    )
