"""Personal data replaced by surrogates: keyed, of the same type, script, gender and format, distinct and consistent.

Entities are e-mail and IP addresses, telephone, card, account and social security numbers, and names after a title or
with a known first name; in a text with a name also further mentions of its words. Each consists of units that are replaced: a number is one unit whatever its separators, an
address whatever its case, a name has a unit per word. A unit's surrogate is drawn from a keyed digest of the unit,
so that all its mentions get the same one. Draws are checked: of units that drew the same surrogate one keeps it, the
others draw again, as do those that drew what is itself a unit of the corpus, so that different units stay different
and no surrogate names somebody else. Draws of later rounds use longer names.

Built-in expressions only. Rows with entities are stored once; units and entities are aggregated before they are
joined; only rows with entities are shuffled, by the digest of their text, and copies of a text share one row of
surrogates.

Defined results: null and empty texts stay as they are; a text without entities is unchanged; repeated rows get the
same result; overlapping entities go to the leftmost; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.session import cut, spread

#: Rounds of drawing before a type counts as exhausted.
ROUNDS = 40

# Titles and first names by which names are found, and what surrogate names are made of.
TITLES = {
    "m": "Mr Herr Herrn Monsieur Señor Signor Mister господин",
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Señorita Signora госпожа",
    "n": "Dr Prof Professor доктор",
}
FIRST_NAMES = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Peter Paul Hans Karl Jürgen Wolfgang Pierre "
    "Jean Jacques François José Juan Carlos Luis Miguel Иван Сергей Дмитрий Алексей Андрей",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Ursula Monika Petra Sabine Marie "
    "Nathalie Isabelle Sylvie Catherine María Carmen Ana Josefa Lucía Мария Анна Ольга Елена Наталья",
}
STEMS = {
    "latin": "bal cor dan fen gil har jon kel lim mar nor pas rin sol tam ver".split(),
    "cyrillic": "бал кор дан фен гил хар ион кел лим мар нор пас рин сол там вер".split(),
}
ENDINGS = {
    "latin": {"m": "as en or im".split(), "f": "a ia ena ira".split(), "n": "ey is el in".split(), "last": "er man son ford".split()},
    "cyrillic": {"m": "ас ен ор им".split(), "f": "а ия ена ира".split(), "n": "ей ис ел ин".split(), "last": "ко дзе ян ник".split()},
}

_CAP = r"(?:\p{Lu}\p{L}++|\p{Lu}['’]\p{Lu}\p{L}++)(?:['’-]\p{Lu}\p{L}++)*+"
#: A capitalised word, for further mentions of a name.
WORD = rf"(?<![\p{{L}}\p{{N}}_]){_CAP}"
_TITLE = "(?:" + "|".join(" ".join(TITLES.values()).split()) + r")(?!\p{L})\.?"
_FIRST = "(?:" + "|".join(" ".join(FIRST_NAMES.values()).split()) + ")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
KINDS = {
    # parts are bounded as the standards bound them, so that long runs of letters cost no more than their length
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9-]{0,62}[A-Za-z0-9]){1,10}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ipv6": rf"(?<![A-Za-z0-9:.])(?=[A-Fa-f:]{{0,38}}+[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![A-Za-z0-9:]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.])\d{4}(?:(?:[ -]?\d{4}){2}[ -]?\d{1,7}|[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![A-Za-z0-9])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3,4}[ .-]\d{4})(?![A-Za-z0-9])"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d(?:[ ./-]?\d){5,12}(?![A-Za-z0-9])"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![A-Za-z0-9])"
    # with a trunk zero: 9 to 12 digits in groups, and no date
    r"|(?<![A-Za-z0-9.,:/+-])(?!\d{1,2}[./-]\d{1,2}[./-]\d{2,4}(?!\d|[./-]\d))(?=0(?:[ ./-]?\d){8,11}(?![A-Za-z0-9]|[ .,:/-]\d))"
    r"0[1-9]\d{0,3}(?:[ ./-]\d{1,8}){1,5}(?![A-Za-z0-9]|[ .,:/-]\d)",
    # the first look ahead spares most places the long list
    "name": rf"(?<![\p{{L}}\p{{N}}_])(?=[\p{{Lu}}гд])(?:{_TITLE} {_CAP}(?: {_CAP})?|{_FIRST}(?:-\p{{Lu}}\p{{L}}++)? {_CAP})",
}
PATTERN = "|".join(f"(?:{x})" for x in KINDS.values())


def entities(text: Column) -> Column:
    """All entities of a text in order; none for null."""
    given = F.coalesce(text, F.lit(""))
    names = F.regexp_extract_all(given, F.lit(KINDS["name"]), F.lit(0))
    # everything but names has a digit or an @
    return F.when(given.rlike("[0-9@]"), F.regexp_extract_all(given, F.lit(PATTERN), F.lit(0))).otherwise(names)


def _kind(entity: Column) -> Column:
    tests = [F.when(entity.rlike(f"^(?:{x})$"), F.lit(k)) for k, x in KINDS.items()]
    return F.coalesce(*tests, F.lit("name"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _is_one_of(x: Column, words: dict[str, str], gender: str) -> Column:
    return x.isin(words[gender].split())


def _units(entity: Column, kind: Column) -> Column:
    """array of (at, kind, unit, raw): the parts of an entity that are replaced; others have no kind."""
    token = F.split(entity, " ")
    title = F.regexp_replace(token[0], r"\.$", "")
    titled = reduce(lambda a, b: a | b, (_is_one_of(title, TITLES, g) for g in TITLES))
    first = F.when(titled, F.when(F.size(token) > 2, token[1])).otherwise(token[0])
    gender = F.coalesce(
        F.when(_is_one_of(title, TITLES, "m") & titled, F.lit("m")),
        F.when(_is_one_of(title, TITLES, "f") & titled, F.lit("f")),
        F.when(_is_one_of(F.substring_index(first, "-", 1), FIRST_NAMES, "m"), F.lit("m")),
        F.when(_is_one_of(F.substring_index(first, "-", 1), FIRST_NAMES, "f"), F.lit("f")),
        F.lit("n"),
    )

    def name_part(x: Column, at: Column) -> Column:
        none = F.lit(None).cast("string")
        part = F.when(titled & (at == 0), none).when(at == F.size(token) - 1, F.lit("last")).otherwise(F.concat(F.lit("first_"), gender))
        return F.struct(at.cast("int").alias("at"), part.alias("kind"), F.lower(x).alias("unit"), x.alias("raw"))

    plain = (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "ip", entity)
        .when(kind == "ipv6", F.lower(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "phone", F.right(_digits(entity), F.lit(10)))
        .otherwise(_digits(entity))
    )
    whole = F.array(F.struct(F.lit(0).alias("at"), kind.alias("kind"), plain.alias("unit"), entity.alias("raw")))
    return F.when(kind == "name", F.transform(token, name_part)).otherwise(whole)


def _stream(*parts: Column) -> Column:
    """64 numbers below 256 from a digest of the parts."""
    hexes = F.concat(*(F.sha2(F.concat_ws("\u0001", *parts, F.lit(str(i))), 256) for i in range(2)))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def _redrawn(text: Column, stream: Column) -> Column:
    """Each letter another letter and each digit another digit; the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        v = stream[F.pmod(i, F.lit(64))]
        letter = F.chr(F.lit(97) + v % 26)
        return F.when(c.rlike("^[0-9]$"), (v % 10).cast("string")).when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _check_digit(digits: Column) -> Column:
    """The last digit that makes a card number valid, from the digits before it."""
    n = F.length(digits)

    def weighted(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weighted), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def _name(unit: Column, kind: str, stream: Column, draw: int) -> Column:
    def made(script: str) -> Column:
        stems, ends = (F.array(*map(F.lit, x)) for x in (STEMS[script], ENDINGS[script][kind.removeprefix("first_")]))
        parts = [stems[stream[i] % len(STEMS[script])] for i in range(min(2 + draw, 40))]
        return F.concat(*parts, ends[stream[63] % 4])

    return F.when(unit.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def _drawn(units: DataFrame, key: str, draw: int) -> DataFrame:
    """Adds the surrogate of each unit (columns kind, unit) in a round.

    The digests are columns of their own: an expression that is used for each character would be worked out for each.
    """
    kind, unit, stream, places = (F.col(c) for c in ("kind", "unit", "__s", "__h"))
    local, domain = F.substring_index(unit, "@", 1), F.substring_index(unit, "@", -1)
    host, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.regexp_extract(domain, r"\.[^.]*$", 0)
    hosts = F.when(kind == "email", _stream(F.lit(key), F.lit("host"), host))
    streams = units.withColumns({"__s": _stream(F.lit(key), kind, unit, F.lit(str(draw))), "__h": hosts})
    email = F.concat(_redrawn(local, stream), F.lit("@"), _redrawn(host, places), top)
    ip = F.concat_ws(".", *((F.lit(1) + stream[i] % 223).cast("string") for i in range(4)))
    groups = (F.lpad(F.lower(F.hex(stream[2 * i] * 256 + stream[2 * i + 1])), 4, "0") for i in range(6))
    ipv6 = F.concat_ws(":", F.lit("2001:db8"), *groups)  # the range for documentation
    body = F.substr(unit, F.lit(1), F.length(unit) - 1)
    valid = _check_digit(body) == F.right(unit, F.lit(1))
    card = _redrawn(body, stream)
    card = F.concat(card, F.when(valid, _check_digit(card)).otherwise((stream[63] % 10).cast("string")))
    iban = F.concat(F.left(unit, F.lit(2)), _redrawn(F.substr(unit, F.lit(3)), stream))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card).when(kind == "iban", iban)
    for name in ("first_m", "first_f", "first_n", "last"):
        out = out.when(kind == name, _name(unit, name, stream, draw))
    return streams.withColumn("surrogate", out.otherwise(_redrawn(unit, stream))).drop("__s", "__h")


def surrogates(units: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, unit, surrogate for distinct units (kind, unit): distinct within a kind, and none of them a unit."""
    units = cut(spread(units, "kind", "unit"))  # few bytes, but heavy work per row
    pending, done = units, None
    for draw in range(rounds):
        drawn = _drawn(pending, key, draw)
        free = drawn.join(units.select("kind", F.col("unit").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        new = cut(free.groupBy("kind", "surrogate").agg(F.min("unit").alias("unit")).select("kind", "unit", "surrogate"))
        done = new if done is None else done.unionByName(new)
        pending = cut(pending.join(new, ["kind", "unit"], "left_anti"))
        if pending.isEmpty():
            return done
    raise ValueError(f"after {rounds} rounds some units still have no surrogate of their own; their type is exhausted")


def _cased(raw: Column, surrogate: Column) -> Column:
    return F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def _formatted(raw: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the format of its mention: separators and case as they were."""
    name = _cased(raw, surrogate)
    letters = F.split(raw, "")
    kept = F.greatest(F.length(_digits(raw)) - F.length(surrogate), F.lit(0))  # a country's code before a number

    def digit(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substr(raw, F.lit(1), i)))
        return F.when(c.rlike("^[0-9]$") & (before >= kept), F.substr(surrogate, before - kept + 1, F.lit(1))).otherwise(c)

    def cased(c: Column, i: Column) -> Column:
        new = F.substr(surrogate, i + 1, F.lit(1))
        return F.when(c.rlike("^[A-Z]$"), F.upper(new)).otherwise(new)

    def spaced(c: Column, i: Column) -> Column:
        return F.when(c == " ", c).otherwise(F.substr(surrogate, F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), " ", "")) + 1, F.lit(1)))

    return (
        F.when(kind.isin("ip", "ipv6"), surrogate)
        .when(kind == "email", F.array_join(F.transform(letters, cased), ""))
        .when(kind == "iban", F.array_join(F.transform(letters, spaced), ""))
        .when(kind.isin("phone", "card", "ssn"), F.array_join(F.transform(letters, digit), ""))
        .otherwise(name)
    )


def replace(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """docs with surrogates in place of entities, and the number of entities."""
    columns = [c for c in docs.columns if c != count]
    found = docs.select(*columns).withColumn("__e", entities(F.col(text)))
    clean = found.where(F.size("__e") == 0).select(*columns, F.lit(0).cast("long").alias(count))
    hits = cut(found.where(F.size("__e") > 0).withColumn("__k", F.sha2(F.col(text).cast("binary"), 256)))
    mentions = hits.select(F.explode(F.array_distinct("__e")).alias("entity")).distinct()
    typed = mentions.withColumn("__kind", _kind(F.col("entity")))
    parts = cut(typed.select("entity", F.explode(_units(F.col("entity"), F.col("__kind"))).alias("p")).select("entity", "p.*"))
    table = surrogates(parts.where("kind is not null").select("kind", "unit").distinct(), key)
    drawn = parts.join(table, ["kind", "unit"], "left").select(
        "entity", "at", F.coalesce(_formatted(F.col("raw"), F.col("kind"), F.col("surrogate")), F.col("raw")).alias("new")
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "new")))
    entity_map = cut(drawn.groupBy("entity").agg(F.array_join(F.transform(ordered, lambda x: x["new"]), " ").alias("new")))
    texts = hits.select("__k", "__e").groupBy("__k").agg(F.first("__e").alias("__e"))
    places = texts.select("__k", F.posexplode("__e").alias("at", "entity")).join(entity_map, "entity")
    arrays = places.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("__new"))
    named = parts.where(F.col("kind").rlike("^(?:first_|last)")).select("entity", "kind", "unit").join(table, ["kind", "unit"])
    own = texts.select("__k", F.explode(F.array_distinct("__e")).alias("entity")).join(named, "entity")
    own = own.groupBy("__k", "unit").agg(F.max_by("surrogate", "kind").alias("surrogate"))  # a last name before a first name
    own = own.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("unit", "surrogate"))).alias("__own"))
    found_words = F.transform("__between", lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))
    again = F.size(F.filter(F.flatten(found_words), lambda w: F.map_contains_key("__own", F.lower(w))))

    def renamed(piece: Column) -> Column:
        """Further mentions of the text's own names between its entities."""
        words = F.regexp_extract_all(piece, F.lit(WORD), F.lit(0))
        words = F.transform(words, lambda w: F.coalesce(_cased(w, F.try_element_at("__own", F.lower(w))), w))
        return _joined(F.split(piece, WORD, -1), words)

    between = F.when(F.col("__own").isNull(), F.col("__between")).otherwise(F.transform("__between", renamed))
    rebuilt = _joined(between, F.transform("__new", lambda x: x["new"]))
    n = F.size("__e") + F.when(F.col("__own").isNull(), 0).otherwise(again)
    hits = hits.join(arrays.join(own, "__k", "left"), "__k").withColumn("__between", F.split(F.col(text), PATTERN, -1))
    done = hits.select(*(rebuilt.alias(c) if c == text else F.col(c) for c in columns), n.cast("long").alias(count))
    return clean.unionByName(done)


def _joined(between: Column, found: Column) -> Column:
    """The text of the pieces with one of `found` after each but the last."""
    return F.array_join(F.flatten(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
