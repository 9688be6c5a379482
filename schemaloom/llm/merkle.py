"""Merkle manifest of a dataset: a content-addressed DAG of digests, and a proof for each row by descending it.

1. A row's leaf is the digest of its values. Within a group (a language) leaves are numbered in order; runs of `FAN`
   consecutive nodes become nodes of the next level, and the last one is the group's root. The groups' roots are the
   leaves of one more tree of the same kind, whose root stands for the dataset. Each level is stored as records digest
   -> children.
2. All requests descend together from the root. Requests for the leaves below a node share its path, so that one row
   stands for all of them: it is looked up by its digest, becomes one row for each child (one digit of the rank, to
   base `FAN`), and takes that child's siblings along as a segment of the path, left and right apart. Below the last records each
   row parts into its leaves.
3. The path, root first, is reversed: siblings in a row make up the proof, and folding a leaf with them gives a root,
   which equals the dataset's only if the leaf is unchanged.

Rows of a level are as many as its nodes, so that what is joined and moved shrinks by `FAN` with each level; leaves
are numbered by ranges, never by a window over a language.

Defined results: a null value is `-`; texts are taken whole; rows that repeat an id are leaves of their own, in the order of
their leaf; null ids come first, and so does the null group; a group of one leaf has it as its root, and a dataset of one
group has that group's root; a null id is not tampered with; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.session import cut

FAN = 8
VALUES = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def value(column: Column) -> Column:
    """One value as text that no other value gives."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes with rank (from 0, in their group) and total (nodes of the group): columns `group` and those of `order`."""
    n, by = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["group", *order, "_row"]
    dealt = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    dealt = cut(dealt.withColumns({"_at": F.monotonically_increasing_id(), "_range": F.spark_partition_id()}).drop("_row"))
    ranges = dealt.groupBy("group", "_range").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy("group")  # one row per range
    before = F.sum("_n").over(all_.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(
        F.col("group").alias("_g"), F.col("_range").alias("_r"), "_low", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(all_).alias("total")
    )
    joined = dealt.join(ranges, dealt["group"].eqNullSafe(ranges["_g"]) & (dealt["_range"] == ranges["_r"]))
    rank = (F.col("_at") - F.col("_low") + F.col("_before")).alias("rank")
    return joined.select(*nodes.columns, rank, "total")


class Tree:
    """One tree for each group of ranked nodes (group, rank, total, digest, and what else a leaf carries)."""

    def __init__(self, nodes: DataFrame):
        # levels above the leaves: digits of the last rank; none for a lone leaf
        height = F.when(F.col("total") == 1, 0).otherwise(F.length(F.conv((F.col("total") - 1).cast("string"), 10, FAN)))
        rest = [c for c in nodes.columns if c not in ("group", "rank", "total")]
        nodes = nodes.withColumn("height", height)
        self.runs = cut(self._grown(nodes, rest).withColumn("level", F.least(F.lit(1), F.col("height"))))
        self.height = self.runs.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]
        self.records = {}
        level, roots = self.runs, self.runs.where("level = height")
        for k in range(2, self.height + 1):
            level = self._grown(level.where(f"height >= {k}").drop("leaves", "children"), ["digest"])
            level = cut(level.drop("leaves").withColumn("level", F.lit(k)))
            self.records[k] = level.select("digest", "children").dropDuplicates(["digest"])
            roots = roots.select("group", "height", "digest").unionByName(level.where("level = height").select("group", "height", "digest"))
        self.roots = roots.select("group", "height", "digest")

    @staticmethod
    def _grown(nodes: DataFrame, rest: list[str]) -> DataFrame:
        """The nodes of the next level; a lone node stays what it is."""
        runs = nodes.groupBy("group", "height", F.expr(f"rank div {FAN}").alias("rank"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("leaves"))
        children = F.transform("leaves", lambda x: x["digest"])
        own = F.when(F.col("height") == 0, children[0]).otherwise(digest(F.array_join("children", "")))
        return runs.withColumn("children", children).withColumn("digest", own)

    def descend(self, requests: DataFrame) -> DataFrame:
        """requests (group, height, digest, path, more) moved down from the roots to runs: rank of the run, path longer."""
        now = requests.withColumn("rank", F.lit(0).cast("long"))
        for k in range(self.height, 1, -1):
            # those of lower trees wait for their level
            inner, waiting = now.where(f"height >= {k}"), now.where(f"height < {k}")
            inner = inner.join(self.records[k], "digest").select("*", F.posexplode("children").alias("digit", "child"))
            path = F.concat("path", F.array(segment(F.col("children"), F.col("digit"))))
            inner = inner.withColumns({"path": path, "rank": F.col("rank") * FAN + F.col("digit"), "digest": F.col("child")})
            now = waiting.unionByName(inner.drop("children", "digit", "child"))
        return now

    def leaves(self, requests: DataFrame) -> DataFrame:
        """requests moved down to the leaves: what a leaf carries, and path."""
        runs = self.runs.select(F.col("group").alias("_g"), F.col("rank").alias("_k"), F.col("digest").alias("_d"), "children", "leaves")
        down = self.descend(requests)
        same = down["group"].eqNullSafe(runs["_g"]) & (down["rank"] == runs["_k"]) & (down["digest"] == runs["_d"])
        found = down.join(runs, same).drop("rank", "digest").select("*", F.posexplode("leaves").alias("digit", "leaf"))
        own = F.when(F.col("height") > 0, F.array(segment(F.col("children"), F.col("digit")))).otherwise(F.array().cast(_PATH))
        kept = [c for c in requests.columns if c not in ("digest", "height", "path", "group")]
        return found.select("group", *kept, "leaf.*", F.concat("path", own).alias("path")).drop("rank")


def segment(children: Column, digit: Column) -> Column:
    """The siblings of a child, before and after it."""
    before = F.array_join(F.slice(children, 1, digit), "")
    after = F.array_join(F.slice(children, digit + 2, FAN), "")
    return F.struct(before.alias("before"), after.alias("after"))


def proof(path: Column) -> Column:
    """The siblings on the way up, in a row."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path (leaf first) lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def manifest(docs: DataFrame, tampered: Column, group: str = "lang", key: str = "doc_id", values: Sequence[str] = VALUES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where `tampered` holds, the A-Z of text are small in the leaf that is folded, and nowhere else.
    """
    encoded = {c: value(F.col(c)) for c in values}
    changed = {**encoded, "text": value(F.translate("text", UPPER, LOWER))}
    leaves = docs.select(
        F.col(group).alias("group"),
        F.col(key).cast("long").alias("doc_id"),
        digest(*encoded.values()).alias("digest"),
        F.when(tampered, digest(*changed.values())).alias("tampered"),
    )
    below = Tree(ranked(leaves, ["doc_id", "digest"]))
    tops = below.roots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest", F.col("height").alias("below"))
    above = Tree(ranked(tops, ["name"]))
    start = above.roots.select("group", "height", "digest", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    groups = above.leaves(start)
    requests = groups.select(F.col("name").alias("group"), F.col("below").alias("height"), "digest", "path", "root", F.col("digest").alias("subroot"))
    found = below.leaves(cut(requests)).withColumn("path", F.reverse("path"))
    end = folded(F.coalesce("tampered", "digest"), F.col("path"))
    out = found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), end.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
