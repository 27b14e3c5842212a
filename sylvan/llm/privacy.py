"""Personal data replaced by surrogates, in DataFrame functions only.

Detected: e-mail addresses (domains of 128 labels at most), IBANs, card numbers of 15 and 16 digits, phone numbers (after +, or ten digits in the North American form), social
security numbers, IPv4 and IPv6 addresses, names after a title, and in the same text later mentions of such a name without one. No pattern repeats a group without
a small bound, so texts of any length are safe. Each entity gets a surrogate of its own kind, keyed by `key`, the same wherever it occurs:

- digits (phone, card, SSN, IBAN) pass a keyed Feistel permutation of their own length, IPv4 one of 32 bits, and go back into the same separators; a country code
  and an IBAN's letters stay, a card keeps its Luhn remainder, an IBAN gets its check digits. A permutation cannot make two numbers one.
- e-mail: keyed letters, the address's own trailing separator and as many digits, and a keyed domain under example.com (one per domain); capitals
  where the address is all capitals. IPv6: 96 keyed bits under the documentation prefix.
- names: the title stays; a given name and a surname each get a keyed name in the same script (Latin or Cyrillic), the given name with an ending of the
  title's gender, all capitals where they were. A surname is the same with or without a given name or title.

What is hashed rather than permuted is checked before anything is replaced: of all distinct units (an address, a domain, a given name, a surname) that have the same
piece of surrogate, all but the least get a higher salt, which also lengthens the piece, until no two are equal (collisions()). That holds for any number of
them: a few salts go into the plan, more are joined to the texts that need them.

Null text stays null, empty text empty; repeated rows are replaced alike; other columns are kept as they are, and the added one is called entities, with
underscores after it while the input has a column of that name; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, written

#: Salts that go into the plan as a literal map; more are a joined table.
LITERAL_SALTS = 256

# The titles by gender, the countries that have IBANs, the two-digit country codes of telephone numbers, and the patterns.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "г-н", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Señorita", "г-жа", "госпожа")
IBAN_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY "
    "MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
).split()
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
NAME = r"\p{Lu}[\p{L}'’-]+"
TITLES = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
GROUP = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}",
    "iban": rf"(?<![A-Za-z0-9])(?:{'|'.join(IBAN_COUNTRIES)})\d{{2}}\x20?[A-Z0-9]{{4}}(?:\x20?(?=[A-Z]{{0,3}}\d)[A-Z0-9]{{4}}){{1,6}}(?:\x20?(?=[A-Z]{{0,2}}\d)[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])",
    "card": r"(?<![\w+])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\w)",
    "phone": r"(?<![\w+.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+(?:\d[ .()-]{0,2}){6,12}\d|(?<!-)[2-9]\d{9}(?![.-]?\d))(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f]{{3,4}}:)(?=[A-Fa-f]{{0,3}}\d)(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}})(?![\w:])",
    "name": rf"(?<![\p{{L}}-])(?:{TITLES})\.?\x20{NAME}(?:\x20{NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
TITLED = rf"^(?:{TITLES})\.?\x20"

# Syllables, sixteen to a script, and endings of given names by gender.
LATIN = "ba de fi go ha ke li mo na pe ri so ta ve lu zo".split()
CYRILLIC = "ба де фи го ха ке ли мо на пе ри со та ве лу зо".split()
ENDINGS = {("latin", "m"): ["n", "s", "r", "l"], ("latin", "f"): ["a", "na", "lia", "ra"], ("cyrillic", "m"): ["н", "с", "р", "л"], ("cyrillic", "f"): ["а", "на", "лия", "ра"]}
ROUNDS = 6
HEX = "0123456789abcdef"
LETTERS = "abcdefghijklmnop"

Salt = Callable[[Column], Column]


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(p.cast("string") for p in parts)), 256)


def _permuted(left: Column, right: Column, left_size: Column, right_size: Column, key: str) -> Column:
    """struct<l, r>: a keyed permutation of the pairs (left, right) with left under left_size and right under right_size."""

    def turn(s: Column, i: Column) -> Column:
        step = lambda other, size: F.pmod(F.xxhash64(F.lit(key), i, other, size), size)
        on_left = F.struct(F.pmod(s["l"] + step(s["r"], left_size), left_size).alias("l"), s["r"].alias("r"))
        on_right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + step(s["l"], right_size), right_size).alias("r"))
        return F.when(i % 2 == 0, on_left).otherwise(on_right)

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _tens(n: Column) -> Column:
    return F.get(F.lit([10**i for i in range(17)]), n)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(digits: Column, key: str) -> Column:
    """As many digits for 1 to 32 digits."""

    def build(x: Column) -> Column:
        a, b = x["a"], x["b"]
        half = lambda start, n: F.coalesce(F.substr(x["d"], start, n).try_cast("bigint"), F.lit(0))
        p = _permuted(half(F.lit(1), a), half(a + 1, b), _tens(a), _tens(b), key)
        return _let(p, lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), b, F.lit("0"))))

    n = F.char_length(digits)
    return _let(F.struct(digits.alias("d"), F.floor(n / 2).cast("int").alias("a"), (n - F.floor(n / 2)).cast("int").alias("b")), build)


def _filled(shape: Column, characters: Column, kind: str = "[0-9]") -> Column:
    """shape with its characters of a kind replaced, in order, by others."""

    def put(acc: Column, c: Column) -> Column:
        own = c.rlike(kind)
        return F.struct(F.concat(acc["out"], F.when(own, F.substr(characters, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda acc: acc["out"])


def _luhn(payload: Column) -> Column:
    """The Luhn sum of the digits before a check digit."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(payload), ""), value), F.lit(0), lambda s, x: s + x)


def _phone(m: Column, key: str) -> Column:
    """After +, the country code stays (one digit for 1 and 7, else two or three); what follows, and a number without one, is permuted."""

    def build(d: Column) -> Column:
        code = F.when(~F.startswith(m, F.lit("+")), 0).when(F.substring(d, 1, 1).isin("1", "7"), 1).when(F.substring(d, 1, 2).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
        return _let(code, lambda c: F.concat(F.substr(d, F.lit(1), c), _permuted_digits(F.substr(d, c + 1, F.lit(20)), key + "phone")))

    return _filled(m, _let(_digits(m), build))


def _card(m: Column, key: str) -> Column:
    def build(d: Column) -> Column:
        n = F.char_length(d)
        payload, check = F.substr(d, F.lit(1), n - 1), F.substr(d, n, F.lit(1)).cast("int")
        return _let(_permuted_digits(payload, key + "card"), lambda p: F.concat(p, F.pmod(_luhn(payload) + check - _luhn(p), F.lit(10)).cast("string")))

    return _filled(m, _let(_digits(m), build))


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay, digits are permuted, check digits worked out (ISO 7064, mod 97)."""

    def value(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    def build(x: Column) -> Column:
        country, account = F.substring(x, 1, 2), F.substring(x, 5, 40)
        own = _filled(account, _permuted_digits(_digits(account), key + "iban"))
        rest = lambda a: F.aggregate(F.split(F.concat(a, country, F.lit("00")), ""), F.lit(0), value)
        return _let(own, lambda a: F.concat(country, F.lpad((98 - rest(a)).cast("string"), 2, "0"), a))

    return _filled(m, _let(F.replace(m, F.lit(" "), F.lit("")), build), "[A-Z0-9]")


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    octet = lambda i: F.get(parts, F.lit(i)).cast("bigint")
    size = F.lit(65_536).cast("bigint")
    p = _permuted(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), size, size, key + "ip")
    return _let(p, lambda s: F.concat_ws(".", *(x.cast("string") for half in (s["l"], s["r"]) for x in (F.shiftright(half, 8), half.bitwiseAND(F.lit(255))))))


def _ssn(m: Column, key: str) -> Column:
    return _filled(m, _let(_digits(m), lambda d: _permuted_digits(d, key + "ssn")))


def _letters(h: Column, n: Column) -> Column:
    return F.translate(F.substr(h, F.lit(1), n), HEX, LETTERS)


def _spelt(h: Column, script: Column, n: Column) -> Column:
    """n syllables of a script (0 Latin, 1 Cyrillic) by a digest's digits."""
    tables = F.lit([*LATIN, *CYRILLIC])
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.get(tables, script * 16 + F.conv(F.substr(h, k, F.lit(1)), 16, 10).cast("int"))), "")


def piece(unit: Column, key: str, salt: Column) -> Column:
    """What a unit (`class:value`; classes email, domain, ipv6, surname, given-m, given-f) turns into, in lower case; a higher salt gives a longer piece."""
    ends = F.lit([e for script in ("latin", "cyrillic") for g in ("m", "f") for e in ENDINGS[script, g]])  # four to a script and gender

    def build(x: Column) -> Column:
        kind, h, salt = x["kind"], x["h"], x["salt"]
        given = F.concat(_spelt(h, x["script"], 3 + salt), F.get(ends, x["script"] * 8 + F.when(kind == "given-m", 0).otherwise(4) + F.conv(F.substring(h, 60, 1), 16, 10).cast("int") % 4))
        groups = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(21), F.lit(4)), lambda at: F.substr(h, at, F.lit(4))), ":")
        return (
            F.when(kind == "email", _letters(h, 16 + salt))
            .when(kind == "domain", _letters(h, 10 + salt))
            .when(kind == "ipv6", groups)
            .when(kind == "surname", _spelt(h, x["script"], 6 + salt))
            .otherwise(given)
        )

    def parts(u: Column) -> Column:
        kind = F.substring_index(u, ":", 1)
        return F.struct(kind.alias("kind"), _digest(key, u, salt).alias("h"), salt.alias("salt"), (kind.isin("surname", "given-m", "given-f") & u.rlike(r"\p{IsCyrillic}")).cast("int").alias("script"))

    return _let(unit, lambda u: _let(parts(u), build))


def _email(m: Column, pieces: Column, key: str) -> Column:
    low = F.lower(m)
    tail = F.regexp_extract(F.substring_index(low, "@", 1), r"[._-]?[0-9]+$", 0)
    digits = F.repeat(F.translate(_digest(key + "tail", low), "abcdef", "012345"), 4)
    whole = F.concat(F.get(pieces, F.lit(0)), _let(F.struct(tail.alias("t"), digits.alias("d")), lambda x: _filled(x["t"], x["d"])), F.lit("@"), F.get(pieces, F.lit(1)), F.lit(".example.com"))
    return _let(whole, lambda w: F.when((m == F.upper(m)) & m.rlike("[A-Z]"), F.upper(w)).otherwise(w))


def _ipv6(m: Column, pieces: Column) -> Column:
    return _let(F.concat(F.lit("2001:db8:"), F.get(pieces, F.lit(0))), lambda w: F.when((m == F.upper(m)) & m.rlike("[A-F]"), F.upper(w)).otherwise(w))


def _name_parts(m: Column) -> Column:
    """struct<title, given, surname, male> of a titled name (no given name: null)."""

    def build(w: Column) -> Column:
        given = F.when(F.size(w) == 3, F.get(w, F.lit(1)))
        return F.struct(F.get(w, F.lit(0)).alias("title"), given.alias("given"), F.element_at(w, -1).alias("surname"), F.regexp_replace(F.get(w, F.lit(0)), r"\.$", "").isin(*MALE).alias("male"))

    return _let(F.split(m, " "), build)


def _mention_parts(m: Column, known: Column) -> Column:
    """The same of a name without a title; its gender is that of the known name that it mentions."""

    def build(w: Column) -> Column:
        given = F.when(F.size(w) == 2, F.get(w, F.lit(0)))
        male = F.get(F.filter(known, lambda k: k["given"] == F.get(w, F.lit(0))), F.lit(0))["male"]
        return F.struct(F.lit(None).cast("string").alias("title"), given.alias("given"), F.element_at(w, -1).alias("surname"), F.coalesce(male, F.lit(False)).alias("male"))

    return _let(F.split(m, " "), build)


def _parts(m: Column, known: Column) -> Column:
    return F.when(m.rlike(TITLED), _name_parts(m)).otherwise(_mention_parts(m, known))


def _name(parts: Column, pieces: Column) -> Column:
    def shown(word: Column, x: Column) -> Column:
        capitals = (word == F.upper(word)) & (F.char_length(word) > 1)
        return F.when(capitals, F.upper(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 999)))

    given = F.when(parts["given"].isNotNull(), shown(parts["given"], F.get(pieces, F.lit(0))))
    return F.concat_ws(" ", parts["title"], given, shown(parts["surname"], F.element_at(pieces, -1)))


def kind_of(m: Column) -> Column:
    """The entity's kind: the first pattern that is the whole of it."""

    def first(x: Column) -> Column:
        out = F.lit("name")
        for kind in reversed([k for k in PATTERNS if k != "name"]):
            out = F.when(x.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
        return out

    return _let(m, first)


def _no_salt(unit: Column) -> Column:
    return F.lit(0)


_NO_NAMES = "array<struct<title:string,given:string,surname:string,male:boolean>>"


def _units(kind: Column, m: Column, parts: Column) -> Column:
    """array<string>: what of an entity is hashed, as `class:value`."""
    low = F.lower(m)
    given = F.when(parts["given"].isNotNull(), F.concat(F.when(parts["male"], "given-m:").otherwise("given-f:"), F.lower(parts["given"])))
    return (
        F.when(kind == "email", F.array(F.concat(F.lit("email:"), low), F.concat(F.lit("domain:"), F.substring_index(low, "@", -1))))
        .when(kind == "ipv6", F.array(F.concat(F.lit("ipv6:"), low)))
        .when(kind == "name", F.array_compact(F.array(given, F.concat(F.lit("surname:"), F.lower(parts["surname"])))))
        .otherwise(F.array().cast("array<string>"))
    )


def surrogate(m: Column, key: str, salt: Salt = _no_salt, known: Column | None = None) -> Column:
    """What stands for the entity m."""
    known = F.array().cast(_NO_NAMES) if known is None else known

    def stand_in(x: Column) -> Column:
        k, e, pieces = x["e"]["k"], x["e"]["m"], x["pieces"]
        return (
            F.when(k == "email", _email(e, pieces, key))
            .when(k == "iban", _iban(e, key))
            .when(k == "card", _card(e, key))
            .when(k == "phone", _phone(e, key))
            .when(k == "ssn", _ssn(e, key))
            .when(k == "ip", _ip(e, key))
            .when(k == "ipv6", _ipv6(e, pieces))
            .otherwise(_name(x["e"]["p"], pieces))
        )

    def with_pieces(e: Column) -> Column:
        pieces = F.transform(_units(e["k"], e["m"], e["p"]), lambda u: piece(u, key, salt(u)))
        return _let(F.struct(e.alias("e"), pieces.alias("pieces")), stand_in)

    kinds = F.struct(m.alias("m"), kind_of(m).alias("k"))
    return _let(kinds, lambda x: _let(F.struct(x["m"].alias("m"), x["k"].alias("k"), F.when(x["k"] == "name", _parts(x["m"], known)).alias("p")), with_pieces))


def able(text: Column) -> Column:
    """Whether a text may hold an entity: a cheap necessary condition (a digit, an @ or a title), then the patterns."""
    some = F.contains(text, F.lit("@")) | text.rlike("[0-9]")
    for title in sorted(MALE + FEMALE):
        some = some | F.contains(text, F.lit(title))
    return some & text.rlike(ANY)


def found(text: Column) -> Column:
    """array<string>: the entities of a text, in order, but for later mentions of a name."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def units(m: Column) -> Column:
    """array<string>: the units of an entity (of found()) whose surrogates are hashed."""
    return _let(F.struct(m.alias("m"), kind_of(m).alias("k")), lambda x: _let(F.struct(x["m"].alias("m"), x["k"].alias("k"), _name_parts(x["m"]).alias("p")), lambda e: _units(e["k"], e["m"], e["p"])))


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """unit, salt (over 0) of the units that would share a piece with another one of their class at a lower salt; distributed rounds over a written table."""
    each = docs.where(able(F.col("text"))).select(F.explode(F.array_distinct(F.flatten(F.transform(found(F.col("text")), units)))).alias("unit")).distinct()
    now = written(each.withColumn("salt", F.lit(0)), "units")
    while True:
        pieces = now.select("unit", "salt", F.regexp_extract("unit", "^[a-z0-9]+", 0).alias("kind"), piece(F.col("unit"), key, F.col("salt")).alias("piece"))
        shared = written(pieces.groupBy("kind", "piece").agg(F.count("*").alias("n"), F.min("unit").alias("least")).where("n > 1").select("kind", "piece", "least"), "shared")
        if shared.isEmpty():
            return now.where("salt > 0")
        again = pieces.join(shared, ["kind", "piece"]).where("unit <> least").select(F.col("unit").alias("u"))
        before, now = now, written(now.join(again, F.col("unit") == F.col("u"), "left").select("unit", (F.col("salt") + F.col("u").isNotNull().cast("int")).alias("salt")), "units")
        forget(before)
        forget(shared)


def _salted(rows: DataFrame, salts: DataFrame) -> tuple[DataFrame, Salt]:
    """rows (text, entities1) and the salt of a unit there: from a literal map, or from a map for each text that has such units, joined by the text's digest."""
    few = salts.limit(LITERAL_SALTS + 1).collect()
    if not few:
        return rows, _no_salt
    if len(few) <= LITERAL_SALTS:
        literal = F.create_map(*(F.lit(x) for r in few for x in (r["unit"], r["salt"])))
        return rows, lambda unit: F.coalesce(F.element_at(literal, unit), F.lit(0))
    rows = rows.withColumn("digest", F.when(F.col("first").isNotNull(), F.sha2("text", 256)))
    wanted = rows.where("digest is not null").select("digest", F.explode(F.array_distinct(F.flatten(F.transform("first", units)))).alias("unit")).distinct()
    maps = wanted.join(salts, "unit").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("unit", "salt"))).alias("salts"))
    return rows.join(maps, "digest", "left"), lambda unit: F.coalesce(F.element_at("salts", unit), F.lit(0))


def replace(docs: DataFrame, key: str, salts: DataFrame | None = None) -> DataFrame:
    """docs with the entities in `text` replaced and a column `entities` (their kinds, in order)."""
    salts = collisions(docs, key) if salts is None else salts
    text, columns = F.col("text"), docs.columns
    rows = docs.select(F.struct("*").alias("row"), "text", F.when(able(text), found(text)).alias("first"))
    rows, salt = _salted(rows, salts)
    rest = [c for c in rows.columns if c != "known"]
    named = F.array_distinct(F.transform(F.filter("first", lambda m: m.rlike(TITLED)), _name_parts))
    rows = rows.select(*rest, F.when(F.exists("first", lambda m: m.rlike(TITLED)), named).otherwise(F.array().cast(_NO_NAMES)).alias("known"))
    mention = lambda k: F.concat_ws("", F.concat(F.lit("(?:"), k["given"], F.lit(r"\x20)?")), k["surname"])
    mentions = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}'’-])(?:"), F.array_join(F.transform("known", mention), "|"), F.lit(r")(?![\p{L}'’-])"))
    rows = rows.select(*rest, "known", F.when(F.size("known") > 0, mentions).otherwise(F.lit(ANY)).alias("pattern"))
    pattern, some = F.col("pattern"), F.col("first").isNotNull()
    rows = rows.select(*rest, "known", F.when(some, F.split(text, pattern, -1)).alias("gaps"), F.when(F.size("known") > 0, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.col("first")).alias("all"))
    pairs = F.zip_with("gaps", F.transform("all", lambda m: surrogate(m, key, salt, F.col("known"))), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))
    changed = F.when(some, F.array_join(F.flatten(pairs), "")).otherwise(text)
    kinds = F.coalesce(F.transform("all", kind_of), F.array().cast("array<string>"))
    own = lambda c: changed if c == "text" else F.col("row").getField(c)
    return rows.select(*(own(c).alias(c) for c in columns), kinds.alias(free_name(docs, "entities")))
