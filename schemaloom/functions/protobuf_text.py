"""Protobuf source text: statements, their nesting, and the canonical text, as column expressions.

A document is one row, so all of this is row-local: no shuffle, and the arrays are as long as one
document. Comments are dropped. Quoted text and bracketed option lists stay whole, so that
delimiters inside them do not count.
"""

from pyspark.sql import Column, functions as F

_QUOTED = r""""(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'"""
_BLANKS = rf"(?s)({_QUOTED})|(?:\s++|//[^\n]*+|/\*.*?\*/)+"
_STATEMENT = rf"""((?:[^;{{}}"'\[]++|{_QUOTED}|\[(?:[^\]"']++|{_QUOTED})*+\])*+[;{{}}])"""

_TAG = r"(0[xX][0-9a-fA-F]+|\d+)"
_FIELD = (
    rf"^(?:(optional|required|repeated)\s+)?(map\s*<\s*[\w.]+\s*,\s*[\w.]+\s*>|[\w.]+)\s+([\w.-]+)\s*=\s*{_TAG}"
    r"\s*(\[.*\])?\s*;$"
)
_CONSTANT = rf"^([\w.]+)\s*=\s*(-?){_TAG}\s*(\[.*\])?\s*;$"
_GROUP = rf"^(?:(?:optional|required|repeated)\s+)?group\s+([\w.]+)\s*=\s*{_TAG}\s*\{{$"
_RPC = r"^rpc\s+([\w.]+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*[;{]$"
_RANGE = r"(?:\d+(?:\s+to\s+(?:\d+|max))?)"
_RESERVED = rf"^reserved\s+(?:(?:{_RANGE}|{_QUOTED})\s*,?\s*)+;$"
_EXTENSIONS = rf"^extensions\s+(?:{_RANGE}\s*,?\s*)+\s*(?:\[.*\])?\s*;$"
_OPTION = r"(?s)^option\s+.+=.*[;{]$"
_FILE_LINE = rf"^(?:syntax\s*=\s*(?:{_QUOTED})|package\s+[\w.]+|import\s+(?:(?:public|weak)\s+)?(?:{_QUOTED}))\s*;$"
_BLOCK = r"^(message|enum|service|extend|oneof)\s+([\w.]+)\s*\{$"

# Which statement may stand in which block, and the largest field number.
ALLOWED = [
    "file>syntax", "file>package", "file>import", "file>option", "file>message", "file>enum", "file>service",
    "file>extend",
    "message>field", "message>option", "message>reserved", "message>extensions", "message>message", "message>enum",
    "message>extend", "message>oneof", "message>group",
    "group>field", "group>option", "group>reserved", "group>extensions", "group>message", "group>enum",
    "group>extend", "group>oneof", "group>group",
    "oneof>field", "oneof>option", "oneof>group",
    "enum>constant", "enum>option", "enum>reserved",
    "service>rpc", "service>option", "rpc>option",
    "extend>field", "extend>group",
]
MAX_TAG = 536870911


def squeeze(raw: Column) -> Column:
    """Text without comments, every run of blanks outside quotes as one or two spaces."""
    return F.regexp_replace(raw, _BLANKS, "$1 ")


def statements(squeezed: Column) -> Column:
    """Array of statements, each with its closing ``;``, ``{`` or ``}``."""
    cut = F.transform(F.regexp_extract_all(squeezed, F.lit(_STATEMENT), F.lit(1)), lambda s: F.trim(s))
    return F.transform(
        cut,
        lambda s: F.struct(s.alias("text"), F.right(s, F.lit(1)).alias("end"), F.regexp_extract(s, r"^(\w+)", 1).alias("word")),
    )


def rest(squeezed: Column) -> Column:
    """What is left after the last statement; blank in a whole document."""
    return F.trim(F.regexp_replace(squeezed, _STATEMENT, ""))


def _kind(s: Column, block: Column) -> Column:
    # the first word is tested before the pattern, which most statements then skip
    text, word = s["text"], s["word"]
    return (
        F.when(text == ";", "empty")
        .when((word == "option") & text.rlike(_OPTION), "option")
        .when(word.isin("message", "enum", "service", "extend", "oneof") & text.rlike(_BLOCK), word)
        .when((word == "rpc") & text.rlike(_RPC), "rpc")
        .when((word == "reserved") & text.rlike(_RESERVED), F.when(_ranges_fit(text), "reserved").otherwise("unknown"))
        .when((word == "extensions") & text.rlike(_EXTENSIONS), "extensions")
        .when((block == "file") & word.isin("syntax", "package", "import") & text.rlike(_FILE_LINE), word)
        .when((s["end"] == "{") & text.rlike(_GROUP), "group")
        .when(block == "enum", F.when(text.rlike(_CONSTANT) & constant_tag(text).isNotNull(), "constant").otherwise("unknown"))
        .when(text.rlike(_FIELD) & field_tag(text).isNotNull(), "field")
        .otherwise("unknown")
    )


_OPEN = "array<struct<kind:string,name:string,path:string>>"
_OUT = "array<struct<kind:string,block:string,scope:string,oneof:string,text:string>>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def nest(parts: Column) -> Column:
    """Walk the statements with a stack of open blocks.

    Gives struct(open, ok, out): the blocks still open, whether every statement was in order, and
    the statements with the kind of their block and their scope, the dotted path of the enclosing message, enum or service. A
    oneof does not open a scope.
    """
    start = F.struct(F.array().cast(_OPEN).alias("open"), F.lit(True).alias("ok"), F.array().cast(_OUT).alias("out"))

    def as_state(open_: Column, ok: Column, out: Column) -> Column:
        return F.struct(open_.alias("open"), ok.alias("ok"), out.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        top = F.try_element_at(acc["open"], F.lit(-1))
        block = F.coalesce(top["kind"], F.lit("file"))
        scope = F.coalesce(top["path"], F.lit(""))

        def inside(fact: Column) -> Column:
            kind, scope_, block_ = fact["kind"], fact["scope"], fact["block"]
            name = F.regexp_extract(s["text"], r"^(?:(?:optional|required|repeated)\s+)?\w+\s+([\w.]+)", 1)
            path = (
                F.when(kind.isin("message", "enum", "group"), F.concat_ws(".", F.nullif(scope_, F.lit("")), name))
                .when(kind == "service", name)
                .when(kind == "extend", F.concat(F.lit("extend "), name))
                .otherwise(scope_)
            )
            allowed = (
                (kind == "empty") | (block_ == "option") | F.concat(block_, F.lit(">"), kind).isin(ALLOWED)
            )
            entry = F.struct(
                kind.alias("kind"),
                block_.alias("block"),
                scope_.alias("scope"),
                F.when(block_ == "oneof", top["name"]).alias("oneof"),
                s["text"].alias("text"),
            )
            # blocks inside an option value are part of it
            opened = F.when(block_ == "option", "option").otherwise(kind)
            pushed = F.concat(acc["open"], F.array(F.struct(opened.alias("kind"), name.alias("name"), path.alias("path"))))
            wanted = (kind != "empty") & (block_ != "option")
            return as_state(
                F.when(s["end"] == "{", pushed).otherwise(acc["open"]),
                acc["ok"] & allowed,
                F.when(wanted, F.concat(acc["out"], F.array(entry))).otherwise(acc["out"]),
            )

        closed = as_state(
            F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0))),
            acc["ok"] & (F.size(acc["open"]) > 0) & ((s["text"] == "}") | (block == "option")),
            acc["out"],
        )
        fact = F.struct(_kind(s, block).alias("kind"), scope.alias("scope"), block.alias("block"))
        return F.when(s["end"] == "}", closed).otherwise(_let(fact, inside))

    return F.aggregate(parts, start, step)


# ---- parts of one statement ----------------------------------------------------------------------


def _number(text: Column) -> Column:
    """Null for a number that is out of all ranges; the statement then is none."""
    hexed = F.conv(F.substring(text, 3, 16), 16, 10)
    return F.when(text.rlike("^0[xX]"), hexed).otherwise(text).try_cast("bigint")


def _ranges_fit(text: Column) -> Column:
    return F.forall(reserved_ranges(text), lambda r: r["lo"].isNotNull() & r["hi"].isNotNull())


def field_label(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _FIELD, 1), F.lit(""))


def field_type(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_extract(text, _FIELD, 2), r"\s+", "")
    return F.regexp_replace(plain, ",", ", ")


def field_name(text: Column) -> Column:
    return F.regexp_extract(text, _FIELD, 3)


def field_tag(text: Column) -> Column:
    return _number(F.regexp_extract(text, _FIELD, 4)).try_cast("int")


def constant_name(text: Column) -> Column:
    return F.regexp_extract(text, _CONSTANT, 1)


def constant_tag(text: Column) -> Column:
    value = _number(F.regexp_extract(text, _CONSTANT, 3))
    return F.when(F.regexp_extract(text, _CONSTANT, 2) == "-", -value).otherwise(value).try_cast("int")


def reserved_ranges(text: Column) -> Column:
    """Closed ranges of a reserved statement: array of struct(lo, hi)."""
    unquoted = F.regexp_replace(text, _QUOTED, "")
    return F.transform(
        F.regexp_extract_all(unquoted, F.lit(rf"({_RANGE})"), F.lit(1)),
        lambda r: F.struct(
            F.regexp_extract(r, r"^(\d+)", 1).try_cast("int").alias("lo"),
            F.when(r.endswith("max"), F.lit(MAX_TAG)).otherwise(F.regexp_extract(r, r"(\d+)$", 1).try_cast("int")).alias("hi"),
        ),
    )


def reserved_names(text: Column) -> Column:
    quoted = F.regexp_extract_all(text, F.lit(f"({_QUOTED})"), F.lit(1))
    return F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def rpc_part(text: Column, group: int) -> Column:
    """1 name, 2 request stream, 3 request, 4 response stream, 5 response."""
    return F.regexp_extract(text, _RPC, group)


# ---- canonical text ------------------------------------------------------------------------------

_FRAMES = "array<struct<kind:string,head:string,parts:array<string>>>"
_PARTS = 8


def _line(s: Column, kind: Column) -> Column:
    """Canonical text of a statement that ends with ``;``, or the head of a block."""
    text = s["text"]
    label = field_label(text)
    opts = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"(\[.*\])\s*;$", 1), r"^\[\s*", "["), r"\s*\]$", "]")
    opts = F.when(opts == "", "").otherwise(F.concat(F.lit(" "), opts))
    flow = lambda g: F.when(rpc_part(text, g) == "", "").otherwise("stream ")
    body = F.regexp_replace(F.regexp_replace(text, r"^\w+\s+", ""), r"\s*[;{]$", "")
    listed = F.regexp_replace(F.regexp_replace(body, r"\s*,\s*", ", "), r"\s+to\s+", " to ")
    return (
        F.when(
            kind == "field",
            F.concat(
                F.when(label.isNull(), "").otherwise(F.concat(label, F.lit(" "))),
                field_type(text), F.lit(" "), field_name(text), F.lit(" = "), field_tag(text).cast("string"),
                opts, F.lit(";\n"),
            ),
        )
        .when(
            kind == "constant",
            F.concat(constant_name(text), F.lit(" = "), constant_tag(text).cast("string"), opts, F.lit(";\n")),
        )
        .when(
            kind == "rpc",
            F.concat(
                F.lit("rpc "), rpc_part(text, 1), F.lit(" ("), flow(2), rpc_part(text, 3), F.lit(") returns ("),
                flow(4), rpc_part(text, 5), F.lit(")"),
            ),
        )
        .when(kind.isin("reserved", "extensions"), F.concat(kind, F.lit(" "), listed, F.lit(";\n")))
        .when(
            kind == "syntax",
            F.concat(F.lit('syntax = "'), F.regexp_extract(text, r"""["'](.*)["']""", 1), F.lit('";\n')),
        )
        .when(kind == "option", F.concat(F.lit("option "), F.regexp_replace(body, r"^([^=]+?)\s*=\s*", "$1 = ")))
        .when(
            kind == "import",
            F.concat(
                F.lit("import "), F.when(text.rlike(r"^import\s+public"), "public ").otherwise(""),
                F.lit('"'), F.regexp_extract(text, r"""["'](.*)["']""", 1), F.lit('";\n'),
            ),
        )
        .when(kind == "package", F.concat(F.lit("package "), body, F.lit(";\n")))
        .otherwise(F.regexp_replace(F.regexp_replace(text, r"\s*\{$", ""), r"\s+", " "))
    )


def _place(block: Column, kind: Column, text: Column) -> Column:
    """Index of the part of the enclosing block that a statement is printed in."""
    in_file = (
        F.when(kind == "syntax", 0).when(kind == "package", 1)
        .when((kind == "import") & text.startswith("import public"), 3).when(kind == "import", 2)
        .when(kind == "option", 4).when(kind.isin("message", "enum"), 5).when(kind == "extend", 6).otherwise(7)
    )
    in_block = (
        F.when(kind == "reserved", 0).when(kind == "option", 1).when(kind.isin("field", "constant", "rpc"), 2)
        .when(kind == "oneof", 3).when(kind == "group", 4).when(kind.isin("extensions", "extend"), 5).otherwise(6)
    )
    return F.when(block == "file", in_file).when(block == "option", 0).otherwise(in_block)


def _indent(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(?=[^\n])", "  ")


def _sections(parts: Column, prefix) -> Column:
    """Non-empty parts, each after a line break."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit("\n"), prefix(p))), "")


def _render(frame: Column) -> Column:
    kind, head, parts = frame["kind"], frame["head"], frame["parts"]
    merged = F.concat(parts[1], parts[2])
    return (
        F.when((kind == "rpc") & (parts[1] == ""), F.concat(head, F.lit(";\n")))
        .when(kind == "rpc", F.concat(head, F.lit(" {\n"), _indent(parts[1]), F.lit("};\n")))
        .when(
            (kind == "enum") & (merged != ""), F.concat(head, F.lit(" {\n"), _indent(merged), F.lit("}\n"))
        )
        .otherwise(F.concat(head, F.lit(" {"), _sections(parts, _indent), F.lit("}\n")))
    )


def canonical(parts: Column) -> Column:
    """Canonical text of the statements of a document that ``nest`` found in order."""
    blank = F.array_repeat(F.lit(""), _PARTS)
    root = F.struct(F.lit("file").alias("kind"), F.lit("").alias("head"), blank.alias("parts"))
    start = F.array(root).cast(_FRAMES)

    def add(frames: Column, depth: Column, index: Column, text: Column) -> Column:
        """Append text to part ``index`` of the frame at ``depth``; deeper frames are dropped."""
        frame = F.element_at(frames, depth)
        grown = F.transform(frame["parts"], lambda p, i: F.when(i == index, F.concat(p, text)).otherwise(p))
        return F.concat(
            F.slice(frames, F.lit(1), depth - 1),
            F.array(F.struct(frame["kind"].alias("kind"), frame["head"].alias("head"), grown.alias("parts"))),
        )

    def step(frames: Column, s: Column) -> Column:
        depth = F.size(frames)
        top = F.element_at(frames, -1)
        block = top["kind"]

        def close(fact: Column) -> Column:
            above = F.element_at(frames, depth - 1)
            return add(frames, depth - 1, _place(above["kind"], fact["kind"], fact["text"]), fact["text"])

        def place(fact: Column) -> Column:
            kind = F.when(block == "option", "option").otherwise(fact["kind"])
            text = F.when(block == "option", F.regexp_replace(s["text"], r"\s*\{$", "")).otherwise(fact["text"])
            opened = F.concat(
                frames, F.array(F.struct(kind.alias("kind"), text.alias("head"), blank.alias("parts")))
            )
            ended = F.when(kind.isin("rpc", "option"), F.concat(text, F.lit(";\n"))).otherwise(text)
            return (
                F.when(s["end"] == "{", opened)
                .when(block == "option", add(frames, depth, F.lit(0), F.concat(s["text"], F.lit(" "))))
                .when(kind == "empty", frames)
                .otherwise(add(frames, depth, _place(block, kind, text), ended))
            )

        def line(kind: Column) -> Column:
            return F.struct(kind.alias("kind"), _line(s, kind).alias("text"))

        # the value of an option is kept as it is written
        body = F.trim(F.regexp_replace(s["text"], r"\}$", ""))
        inner = F.concat(top["parts"][0], F.when(body == "", "").otherwise(F.concat(body, F.lit(" "))))
        within = F.element_at(frames, depth - 1)["kind"] == "option"
        value = F.concat(F.rtrim(top["head"]), F.lit(" { "), inner, F.when(within, "} ").otherwise("};\n"))
        closed = F.when(block == "option", value).otherwise(_render(top))
        closing = F.struct(block.alias("kind"), closed.alias("text"))
        return F.when((s["end"] == "}") & (depth > 1), _let(closing, close)).otherwise(
            _let(_let(_kind(s, block), line), place)
        )

    def file_text(file: Column) -> Column:
        grouped = F.array(F.concat(file[2], file[3]), file[4], file[5], file[6], file[7])
        return F.concat(F.lit("//\n"), file[0], file[1], _sections(grouped, lambda p: p))

    # walked once, however many parts the text is put together from
    return _let(F.element_at(F.aggregate(parts, start, step), 1)["parts"], file_text)
