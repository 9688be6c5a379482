"""The verdict on a registration inside a fold, by the dialect of the latest live version.

Live entries and the operation carry document numbers (``n``) and dialects; the operation also carries the sets of
documents that its own breaks with (``backward``, ``forward``), see ``operators.elements``. No document is
held. Null means that the level is not supported.
"""

from pyspark.sql import Column, functions as F

#: What a live entry is.
ENTRY = "struct<version:int,schema_id:int,n:bigint,dialect:string>"
WORD = 64


def contains(sets: Column, number: Column) -> Column:
    """Whether a set of document numbers (words of 64 bits; null for the empty set) holds a number."""
    word = F.coalesce(F.get(sets, F.floor(number / WORD).cast("int")), F.lit(0).cast("bigint"))
    return F.bit_get(word, F.pmod(number, F.lit(WORD)).cast("int")) == 1


def verdict(level: Column, live: Column, op: Column) -> Column:
    latest = F.element_at(live, -1)
    kind, transitive = latest["dialect"], level.endswith("_TRANSITIVE")

    def beside_all(name: str) -> Column:
        return F.forall(live, lambda e: ~contains(op[name], e["n"]))

    # a transitive level cannot compare with versions of another dialect
    same = (op["dialect"] == kind) & (~transitive | F.forall(live, lambda e: e["dialect"] == kind))

    def answer(names: list[str]) -> Column:
        one, every = F.lit(True), F.lit(True)
        for name in names:
            one, every = one & ~contains(op[name], latest["n"]), every & beside_all(name)
        return F.when(transitive, every).otherwise(one)

    compared = (
        F.when(level.startswith("BACKWARD"), answer(["backward"]))
        .when(level.startswith("FORWARD"), answer(["forward"]))
        .otherwise(answer(["backward", "forward"]))
    )
    checked = level.rlike("^(BACKWARD|FORWARD|FULL)(_TRANSITIVE)?$")
    return (
        # the level does not matter; the raw text has to equal the oldest canonical text, and equal texts have the same id
        F.when(kind == "JSON_SCHEMA", op["exact"] & (live[0]["schema_id"] == op["schema_id"]))
        .when(~checked, True)
        .when((kind == "PROTOBUF") & ~level.startswith("BACKWARD"), F.lit(None))
        .when(~same, False)
        .otherwise(compared)
    )
