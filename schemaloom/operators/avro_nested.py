"""Avro reader/writer rules for nested types, for many document pairs at once.

A question is (pair, reader node, writer node). Questions spread from the roots one level per round,
as joins on the node tables; a question that came up before is not asked again, which also ends the
recursion of named types. Then failures travel back up the same edges until none is new. The number
of rounds follows the depth of the documents, not their number.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.avro import full_aliases, readable
from ..session import cut

_ASK = ["pair", "rpath", "wpath"]


def _simple(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _side(nodes: DataFrame, letter: str) -> DataFrame:
    """What a node is, with prefixed columns."""
    return nodes.select(
        F.col("schema_id").alias(f"{letter}_id"), F.col("path").alias(f"{letter}path"),
        *[F.col(c).alias(f"{letter}_{c}") for c in ("kind", "type", "type_aliases", "symbols", "size")],
    )


def _children(nodes: DataFrame, letter: str) -> DataFrame:
    """Nodes below a node. A reference stands for the definition it names in its document."""
    found = nodes.where("kind in ('record', 'error', 'enum', 'fixed')").select(
        "schema_id", F.col("type").alias("_defined"), F.col("path").alias("_target")
    )
    named = nodes.withColumn("_defined", F.when(F.col("kind") == "ref", F.col("type")))
    return named.join(found, ["schema_id", "_defined"], "left").select(
        F.col("schema_id").alias(f"{letter}_id"), F.col("parent_path").alias(f"{letter}path"),
        F.coalesce("_target", "path").alias(f"{letter}child"), F.col("role").alias(f"{letter}_role"),
        F.col("name").alias(f"{letter}_name"), "aliases", "has_default",
    ).where(F.col(f"{letter}path").isNotNull())


def _judge(asked: DataFrame, r: DataFrame, w: DataFrame) -> DataFrame:
    """Adds how the question splits (mode) and whether it holds as far as the two nodes show."""
    both = asked.join(r, ["r_id", "rpath"]).join(w, ["w_id", "wpath"])
    same = F.col("r_kind") == F.col("w_kind")
    kind = F.col("r_kind")
    mode = (
        F.when(F.col("w_kind") == "union", "all")
        .when(kind == "union", "any")
        .when(same & kind.isin("record", "error"), "fields")
        .when(same & kind.isin("array", "map"), "parts")
        .otherwise("leaf")
    )
    aliases = full_aliases(F.col("r_type"), F.col("r_type_aliases"))
    names = (_simple(F.col("r_type")) == _simple(F.col("w_type"))) | F.array_contains(aliases, F.col("w_type"))
    # size of an enum is 1 if it has a default symbol
    symbols = (F.size(F.array_except("w_symbols", "r_symbols")) == 0) | (F.col("r_size") == 1)
    holds = (
        F.when(mode.isin("all", "any", "parts"), True)
        .when(mode == "fields", names)
        .when(same & (kind == "primitive"), readable(F.col("r_type"), F.col("w_type")))
        .when(same & (kind == "enum"), names & symbols)
        .when(same & (kind == "fixed"), names & (F.col("r_size") == F.col("w_size")))
        .otherwise(False)
    )
    return both.select("r_id", "w_id", *_ASK, mode.alias("mode"), holds.alias("holds"))


def _split(judged: DataFrame, r: DataFrame, w: DataFrame) -> DataFrame:
    """Questions that a question depends on: rchild, wchild; wchild null for a field the writer lacks."""
    held = judged.where("holds")
    keep = ["r_id", "w_id", *_ASK, "mode"]
    by_writer = held.where("mode = 'all'").join(w, ["w_id", "wpath"]).select(*keep, F.col("rpath").alias("rchild"), "wchild")
    by_reader = held.where("mode = 'any'").join(r, ["r_id", "rpath"]).select(*keep, "rchild", F.col("wpath").alias("wchild"))
    parts = (
        held.where("mode = 'parts'").join(r, ["r_id", "rpath"]).join(w.drop("aliases", "has_default"), ["w_id", "wpath"])
        .select(*keep, "rchild", "wchild")
    )
    fields = held.where("mode = 'fields'").join(r.where("r_role = 'field'"), ["r_id", "rpath"])
    # a reader field that several writer fields answer to, by its name and aliases, can be read from none
    called = fields.select(
        *keep, "rchild", "r_name", "has_default",
        F.explode(F.array_distinct(F.concat(F.array("r_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("w_name"),
    )
    matched = (
        called.join(w.select("w_id", "wpath", "w_name", "wchild"), ["w_id", "wpath", "w_name"], "left")
        .groupBy(*keep, "rchild", "r_name", "has_default")
        .agg(F.max("wchild").alias("_any"), F.count_distinct(F.when(F.col("wchild").isNotNull(), F.col("w_name"))).alias("_n"))
        .where((F.col("_n") > 0) | ~F.col("has_default"))
        .select(*keep, "rchild", F.when(F.col("_n") == 1, F.col("_any")).alias("wchild"))
    )
    return by_writer.unionByName(by_reader).unionByName(parts).unionByName(matched)


def nested_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds compatible to distinct pairs (reader_id, writer_id): can the reader read the writer.

    ``nodes`` are the node rows of the documents, keyed by schema_id.
    """
    wanted = cut(
        pairs.select("reader_id", "writer_id").distinct().select(
            F.concat_ws(">", "reader_id", "writer_id").alias("pair"), F.col("reader_id").alias("r_id"), F.col("writer_id").alias("w_id")
        )
    )
    stored = cut(nodes)
    r_nodes, w_nodes = _side(stored, "r"), _side(stored, "w")
    r_below, w_below = cut(_children(stored, "r")), cut(_children(stored, "w"))
    frontier = wanted.select("r_id", "w_id", "pair", F.lit("").alias("rpath"), F.lit("").alias("wpath"))
    judged = edges = None
    while True:
        here = cut(_judge(frontier, r_nodes, w_nodes))
        if here.isEmpty():
            break
        below = cut(_split(here, r_below, w_below))
        judged = here if judged is None else judged.unionByName(here)
        edges = below if edges is None else edges.unionByName(below)
        new = below.where("wchild is not null").select(
            "r_id", "w_id", "pair", F.col("rchild").alias("rpath"), F.col("wchild").alias("wpath")
        )
        frontier = new.distinct().join(judged.select(*_ASK), _ASK, "left_anti")
    if judged is None:
        return wanted.select(F.col("r_id").alias("reader_id"), F.col("w_id").alias("writer_id"), F.lit(True).alias("compatible"))
    failed = _failures(judged, edges)
    roots = failed.where("rpath = '' and wpath = ''").select("pair", F.lit(True).alias("_failed"))
    return wanted.join(roots, "pair", "left").select(
        F.col("r_id").alias("reader_id"), F.col("w_id").alias("writer_id"), F.col("_failed").isNull().alias("compatible")
    )


def _failures(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """All questions answered no: those that fail by themselves, and what depends on them."""
    missing = edges.where("wchild is null").select(*_ASK)
    no_branch = judged.where("mode = 'any'").join(edges, _ASK, "left_anti").select(*_ASK)
    alone = judged.where(~F.col("holds")).select(*_ASK).unionByName(missing).unionByName(no_branch)
    failed = cut(alone.distinct())
    while True:
        lost = edges.join(
            failed.select("pair", F.col("rpath").alias("rchild"), F.col("wpath").alias("wchild"), F.lit(1).alias("_lost")),
            ["pair", "rchild", "wchild"],
            "left",
        )
        # a reader union needs one branch that holds, everything else needs all
        upper = (
            lost.groupBy(*_ASK, "mode").agg(F.count("_lost").alias("lost"), F.count("*").alias("n"))
            .where(F.when(F.col("mode") == "any", F.col("lost") == F.col("n")).otherwise(F.col("lost") > 0))
            .select(*_ASK)
        )
        grown = cut(upper.join(failed, _ASK, "left_anti"))
        if grown.isEmpty():
            return failed
        failed = failed.unionByName(grown)
