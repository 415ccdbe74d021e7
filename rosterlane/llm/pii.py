r"""Personal data: detected entities get keyed surrogates of the same type, format, gender and script.

Method. One pattern of alternatives finds e-mail addresses, secrets, phone and card numbers (16 digits, or another length with a valid check digit), IBANs,
IPv4 addresses, social-security numbers and names behind a title (names without one are not found); each match is reduced to a
canonical form (digits of a number, lower case
of an address or a name's words), so that differently written mentions of one entity are one. A surrogate is drawn
from SHA-2 of (key, type, canonical form, attempt): digits for digits (a ten-digit phone gets the exchange 555), letters for
letters, a valid check digit where there was one, names of the same script whose ending follows the title's gender, poured back into the
match's own punctuation. The same key gives the same surrogate everywhere (coreference); a given name behind a title without
gender gets the surrogate that it has behind one with gender (the female one, if both stand in the texts). Collision check: over all
distinct entities, a surrogate that another entity has, or that is a real entity itself, is drawn again with the next
attempt, until none is left or _ATTEMPTS rounds have passed (distinctness). What is left then, where a format is nearly
full, is given the format's unused values by rank: its values are numbered, as many as can be needed are made, those in
use go, and the k-th entity in the order of a keyed hash gets the k-th that stays. Entities whose format has no value
left (short numbers: more than half of all there are) get one of the next longer format, and so on.

Native: only DataFrame functions. Texts are read twice (entities, rewriting) and not shuffled: a surrogate is an
expression of its match. Only entities whose attempt is not 0 are exceptions: up to `inline` of their surrogates become a literal
map; more are joined to the texts that hold them by the text's digest. Distinct entities pre-aggregate on the map
side, so an entity in a third of all rows is one row per task.

Cases. Null stays null with 0 entities. Texts without a match come back unchanged. Repeated rows and ids are rewritten
alike, row by row. Extra columns of the input are ignored by surrogates(); rewrite() keeps them.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

INLINE = 2000
_ATTEMPTS = 16
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Госпожа|Κυρία"
_MALE = "Mr|Herr|Monsieur|Señor|Signor|Господин|Κύριος"
_TITLES = f"{_FEMALE}|{_MALE}|Dr|Prof"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: In order of precedence: type, pattern, what must not stand before it, what must not stand behind it.
KINDS = [
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", r"[A-Za-z0-9._%+\-]", r"[A-Za-z0-9]"),
    ("secret", r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9\-]{10,}|[0-9a-f]{32,}|[0-9A-F]{32,})", r"[A-Za-z0-9]", r"[A-Za-z0-9]"),
    ("ip", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"[0-9.]", r"\.?[0-9]"),
    ("phone", r"(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})", r"[0-9+\-]", r"[0-9]"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9\-]", r"[0-9\-]"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Za-z0-9]", r"[A-Za-z0-9]"),
    ("card", r"(?:[0-9][ \-]?){12,18}[0-9]", r"[0-9]", r"[0-9]"),
    ("name", rf"(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+){{0,2}}", r"\p{L}", r"\p{L}"),
]
PATTERN = "|".join(f"(?<!{before}){p}(?!{behind})" for _, p, before, behind in KINDS)
_GATE = "@|[0-9][0-9.() \\-]{2}|[0-9a-fA-F]{32}|AKIA|gh[pousr]_|sk-|xox|" + "|".join(f"{t}[. ]" for t in _TITLES.split("|"))
#: Consonants and vowels of each script, and endings of female, male and other given names and of family names.
SCRIPTS = {
    "latin": ("bdfglmnprstvkzhc", "aeiou", ("a", "n", "e"), "er"),
    "cyrillic": ("бвгдзклмнпрстфхж", "аеиоу", ("а", "н", "е"), "ов"),
    "greek": ("βγδζθκλμνπρστφχψ", "αεηιο", ("α", "ος", "η"), "ίδης"),
}
#: A template is a value whose free places hold a character of private use; these are the values of such a place.
_DIGIT, _LOWER, _UPPER, _HEX, _UPPER_HEX, _MAIL, _OCTET_PLACE, _VALID, _INVALID = "\ue000\ue001\ue002\ue003\ue004\ue005\ue006\ue007\ue008"
_SPOKEN = {name: (chr(0xE010 + 2 * i), chr(0xE011 + 2 * i)) for i, name in enumerate(SCRIPTS)}
_VALUES = {
    _DIGIT: "0123456789", _LOWER: "abcdefghijklmnopqrstuvwxyz", _UPPER: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _HEX: "abcdef", _UPPER_HEX: "ABCDEF", _MAIL: "aeioubdfglmnprst",
    _OCTET_PLACE: [str(n) for n in range(1, 255)], _VALID: [""], _INVALID: [""],
    **{place: SCRIPTS[name][k] for name, places in _SPOKEN.items() for k, place in enumerate(places)},
}
#: The exchange of fictitious numbers, and how known secrets begin.
_EXCHANGE = "555"
_ISSUERS = "^(?:AKIA|gh[pousr]_|sk-|xox[abp]-)"
_MOST_VALUES = 10**15  # as many are counted; no table has so many entities
_CHUNK = 4096


def _kind(m: Column) -> Column:
    """The type of a match; null for a long number that is no card's."""
    out = None
    for name, pattern, _, _ in KINDS:
        hit = m.rlike(f"^(?:{pattern})\\z")
        kind = F.when((F.length(_digits(m)) == 16) | F.call_function("luhn_check", _digits(m)), name) if name == "card" else F.lit(name)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("secret")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _name_words(m: Column) -> Column:
    return F.split(F.regexp_replace(m, rf"^(?:{_TITLES})\.? ", ""), " ")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{_FEMALE})[. ]"), "f").when(m.rlike(rf"^(?:{_MALE})[. ]"), "m").otherwise("x")


def _parts(kind: Column, m: Column) -> Column:
    """(type, canon) of what a match is made of: itself, or the words of a name."""
    words, gender = _name_words(m), _gender(m)
    of_name = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "family").otherwise(F.concat(F.lit("given:"), gender)).alias("type"), F.lower(w).alias("canon")))
    phone = F.regexp_extract(_digits(m), r"([0-9]{1,10})\z", 1)
    canon = F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits(m)).when(kind == "email", F.lower(m)).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m)
    return F.when(kind == "name", of_name).otherwise(F.array(F.struct(kind.alias("type"), canon.alias("canon"))))


def _draw(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hexadecimal characters for an entity."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 512)


def _chars(canon: Column, body) -> Column:
    return F.array_join(F.transform(F.filter(F.split(canon, ""), lambda c: c != ""), body), "")


def _at(stream: Column, i: Column) -> Column:
    return F.substring(stream, F.pmod(i, F.length(stream)) + 1, F.lit(1))


def _like(canon: Column, h: Column, letters: str) -> Column:
    """canon with its digits and letters drawn anew, each of its own class and case."""
    digit, letter = F.translate(h, "abcdef", "047258"), F.translate(h, "0123456789abcdef", letters)
    return _chars(canon, lambda c, i: F.when(c.rlike("[0-9]"), _at(digit, i)).when(c.rlike("[a-z]"), _at(letter, i)).when(c.rlike("[A-Z]"), F.upper(_at(letter, i))).otherwise(c))


def _number(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, at, 4), 16, 10).cast("int")


def _issuer(secret: Column) -> Column:
    """What tells whose secret it is; the rest is secret."""
    return F.regexp_extract(secret, _ISSUERS, 0)


def _body(secret: Column) -> Column:
    return F.regexp_replace(secret, _ISSUERS, "")


def _spoken(h: Column, script: Column, kind: Column) -> Column:
    """A name of two or three drawn syllables with the ending of its kind."""
    out = None
    for name, (consonants, vowels, endings, family) in SCRIPTS.items():
        syllable = lambda k: F.concat(_at(F.lit(consonants), _number(h, 8 * k + 1)), _at(F.lit(vowels), _number(h, 8 * k + 5)))  # noqa: E731, B023
        stem = F.concat(syllable(0), syllable(1), syllable(2), F.substring(F.lit(consonants), F.pmod(_number(h, 33), F.lit(16)) + 1, F.lit(1)))
        ending = F.when(kind == "given:f", endings[0]).when(kind == "given:m", endings[1]).when(kind == "given:x", endings[2]).otherwise(family)
        made = F.concat(stem, ending)
        out = F.when(script == name, made) if out is None else out.when(script == name, made)
    return out


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate of the entity (kind, canon)."""
    h = _draw(key, kind, canon, attempt)
    return F.transform(F.array(h), lambda h: _surrogate_of(kind, canon, h))[0]


def _surrogate_of(kind: Column, canon: Column, h: Column) -> Column:
    digit = F.translate(h, "abcdef", "047258")
    email = F.concat(_like(F.substring_index(canon, "@", 1), h, "aeioubdfglmnprst"), F.lit("@"), F.translate(F.substring(h, 97, 8), "0123456789abcdef", "aeioubdfglmnprst"), F.lit(".example.org"))
    octet = lambda k: (F.pmod(_number(h, 4 * k + 1), F.lit(254)) + 1).cast("string")
    body = F.concat(F.substring(canon, 1, 1), F.substring(digit, F.lit(1), F.length(canon) - 2))
    checks = F.transform(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.concat(body, d))
    card = F.when(F.call_function("luhn_check", canon), F.filter(checks, lambda c: F.call_function("luhn_check", c))[0]).otherwise(F.concat(body, F.substring(digit, 60, 1)))
    phone = F.when(F.length(canon) == 10, F.concat(F.substring(digit, 1, 3), F.lit(_EXCHANGE), F.substring(digit, 7, 4))).otherwise(F.substring(digit, F.lit(1), F.length(canon)))
    secret = F.when(canon.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)\z"), _like(canon, h, "abcdefabcdefabcd")).otherwise(F.concat(_issuer(canon), _like(_body(canon), h, "abcdefghijklmnop")))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
        .when(kind == "phone", phone)
        .when(kind == "ssn", F.substring(digit, 1, 9))
        .when(kind == "card", card)
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _like(F.substring(canon, 3, 1 << 20), h, "abcdefghijklmnop")))
        .when((kind == "family") | kind.startswith("given:"), _spoken(h, _script(canon), kind))
        .otherwise(secret)
    )


def _poured(m: Column, kind: Column, made: Column) -> Column:
    """The surrogates of a match's parts in the match's own writing."""
    value = made[0]
    own = _digits(m)
    keep = F.when(kind == "phone", F.greatest(F.length(own) - 10, F.lit(0))).otherwise(0)  # a country code is not part of the canonical number
    rest = F.substring(value, F.length(own) - keep + 1, F.length(value))  # of a longer format
    places = F.filter(F.split(m, ""), lambda c: c != "")
    filled = F.array_join(
        F.transform(
            places,
            lambda c, i: F.when(c.rlike("[0-9]"), F.transform(F.array(F.length(_digits(F.array_join(F.slice(places, 1, i + 1), "")))), lambda k: F.when(k <= keep, c).otherwise(F.substring(value, k - keep, F.lit(1))))[0]).otherwise(c),
        ),
        "",
    )
    words = _name_words(m)
    named = F.concat(
        F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1),
        F.array_join(F.zip_with(words, made, lambda w, s: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(s)).otherwise(F.initcap(s))), " "),
    )
    spaced = F.when(m.contains(" "), F.rtrim(F.regexp_replace(value, "(.{4})", "$1 "))).otherwise(value)
    return F.when(kind.isin("phone", "card", "ssn"), F.concat(filled, rest)).when(kind == "name", named).when(kind == "iban", spaced).otherwise(value)


def find(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __found: array of (raw, kind, parts), null where the gate finds nothing; kind and parts are null where a match is no entity."""
    text = F.col(f"`{text_col}`")
    raw = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("raw"), _kind(m).alias("kind")))
    found = F.transform(raw, lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), F.when(x["kind"].isNotNull(), _parts(x["kind"], x["raw"])).alias("parts")))
    return docs.withColumn("__found", F.when(text.rlike(_GATE), found))


def _template(kind: Column, canon: Column, level: int) -> Column:
    """The values that may stand for an entity: its own format (level 0) or one longer by level places; null for what find() cannot find."""
    n, more = F.length(canon), _DIGIT * level
    classes = lambda lower, upper: _DIGIT * 10 + lower * 26 + upper * 26
    free = lambda c, lower=_LOWER, upper=_UPPER: F.translate(c, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", classes(lower, upper))
    digits = lambda k: F.repeat(F.lit(_DIGIT), k)
    exchange = F.lit(_DIGIT * 3 + _EXCHANGE + _DIGIT * 4)
    phone = F.when((n == 10) & F.lit(level == 0), exchange).when(n == 10, digits(n + (level - 1))).otherwise(digits(n + level))
    card = F.concat(F.substring(canon, 1, 1), digits(n - 2 + level), F.when(F.call_function("luhn_check", canon), _VALID).otherwise(_INVALID))
    email = F.concat(free(F.substring_index(canon, "@", 1)), F.lit("@" + _MAIL * (8 + level) + ".example.org"))
    secret = F.when(canon.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)\z"), free(canon, _HEX, _UPPER_HEX)).otherwise(F.concat(_issuer(canon), free(_body(canon))))
    spoken = None
    for name, (_, _, endings, family) in SCRIPTS.items():
        stem = "".join(_SPOKEN[name]) * (3 + level) + _SPOKEN[name][0]
        ending = F.when(kind == "given:f", endings[0]).when(kind == "given:m", endings[1]).when(kind == "given:x", endings[2]).when(kind == "family", family)
        hit, made = _script(canon) == name, F.concat(F.lit(stem), ending)
        spoken = F.when(hit, made) if spoken is None else spoken.when(hit, made)
    return (
        F.when((kind == "phone") & canon.rlike(r"^[0-9]{4,10}\z"), phone)
        .when((kind == "ssn") & canon.rlike(r"^[0-9]{9}\z"), digits(n + level))
        .when((kind == "card") & canon.rlike(r"^[0-9]{13,19}\z"), card)
        .when(kind == "ip", F.lit(".".join(_OCTET_PLACE * (4 + level))))
        .when((kind == "email") & canon.contains("@"), email)
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), free(F.substring(canon, 3, 1 << 20)), F.lit(more)))
        .when(kind == "secret", F.concat(secret, F.lit(more)))
        .when((kind == "family") | kind.startswith("given:"), spoken)
    )


def _values_at(place: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in _VALUES.items()))
    return F.coalesce(F.element_at(known, place), F.array(place))


def _places(template: Column) -> Column:
    return F.filter(F.split(template, ""), lambda c: c != "")


def _n_values(template: Column) -> Column:
    return F.aggregate(_places(template), F.lit(1).cast("long"), lambda n, c: F.least(n * F.size(_values_at(c)), F.lit(_MOST_VALUES)))


def _nth(template: Column, k: Column) -> Column:
    """The k-th value of a template, from 0: k in the mixed radix of its places."""

    def step(state: Column, c: Column) -> Column:
        put = lambda v: F.struct(F.call_function("div", state["k"], F.size(v)).alias("k"), F.concat(F.get(v, F.pmod(state["k"], F.size(v)).cast("int")), state["made"]).alias("made"))
        return F.transform(F.array(_values_at(c)), put)[0]

    start = F.struct(k.cast("long").alias("k"), F.lit("").alias("made"))
    body = F.aggregate(F.reverse(_places(template)), start, step)["made"]
    last = lambda ok: F.filter(F.array(*[F.concat(body, F.lit(str(d))) for d in range(10)]), ok)[0]
    valid = lambda c: F.call_function("luhn_check", c)
    return F.when(template.endswith(_VALID), last(valid)).when(template.endswith(_INVALID), last(lambda c: ~valid(c))).otherwise(body)


def _ranked(rows: DataFrame, order: str) -> DataFrame:
    """rows with rank, from 1, in their type and template: places in range partitions, and what the partitions before hold."""
    own = ["type", "template"]
    ranged = cut(rows.repartitionByRange(*own, order).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy(*own, "part").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    inside = F.row_number().over(Window.partitionBy(*own, "part").orderBy(order))
    return ranged.withColumn("inside", inside).join(parts, [*own, "part"]).withColumn("rank", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def _by_rank(left: DataFrame, done: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """done and the entities left, each with an unused value of its format or of the next longer one that has some."""
    level = 0
    while True:
        wanted = cut(left.select("type", "canon", "attempt", _template(F.col("type"), F.col("canon"), level).alias("template")))
        if not wanted.where("template is null").isEmpty():
            raise ValueError("surrogates still collide, and some entities are of no known format")
        taken = done.select("type", "made").unionByName(real.select("type", "made"))
        # Of as many values as entities and used ones together, enough are unused.
        needed = wanted.groupBy("type", "template").agg(F.count("*").alias("n")).join(taken.groupBy("type").agg(F.count("*").alias("used")), "type")
        counted = needed.select("type", "template", F.least(F.col("n") + F.col("used"), _n_values(F.col("template"))).alias("n"))
        chunks = counted.select("type", "template", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(_CHUNK)))).alias("c"))
        first = F.col("c") * _CHUNK
        numbers = chunks.repartition("type", "template", "c").select("type", "template", F.explode(F.sequence(first, F.least(first + (_CHUNK - 1), F.col("n") - 1))).alias("k"))
        free = numbers.withColumn("made", _nth(F.col("template"), F.col("k"))).join(taken, ["type", "made"], "left_anti")
        asked = wanted.withColumn("turn", _draw(key, F.col("type"), F.col("canon"), F.lit("rank")))
        given = _ranked(asked, "turn").join(_ranked(free, "k").drop("k"), ["type", "template", "rank"], "left")
        given = cut(given.select("type", "canon", "attempt", "made"))
        done = cut(done.unionByName(given.where("made is not null")))
        left = given.where("made is null")
        if left.isEmpty():
            return done
        level += 1


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, attempt, made) for distinct entities (type, canon): no two alike, none equal to a real one.

    But a given name without gender that also has one is no entity of its own: its row is that name's, with an attempt that is not 0.
    """
    gendered = entities.where("type in ('given:f', 'given:m')").groupBy("canon").agg(F.min("type").alias("as"))
    aliases = cut(entities.where("type = 'given:x'").join(gendered, "canon").select("type", "canon", "as"))
    made = _distinct(cut(entities.join(aliases.drop("as"), ["type", "canon"], "left_anti")), key)
    of = made.select(F.col("type").alias("as"), "canon", (F.col("attempt") + 1).alias("attempt"), "made")
    return made.unionByName(aliases.join(of, ["as", "canon"]).select(*made.columns))


def _distinct(entities: DataFrame, key: str) -> DataFrame:
    """resolve() for entities that are all their own."""
    attempts = cut(entities.select("type", "canon", F.lit(0).alias("attempt")))
    real = entities.select("type", F.col("canon").alias("made"), F.lit(True).alias("real"))
    for _ in range(_ATTEMPTS):
        made = attempts.withColumn("made", _surrogate(key, F.col("type"), F.col("canon"), F.col("attempt")))
        first = Window.partitionBy("type", "made").orderBy("attempt", "canon")
        judged = made.join(real, ["type", "made"], "left").withColumn("again", F.col("real").isNotNull() | (F.row_number().over(first) > 1))
        judged = cut(judged.select("type", "canon", "attempt", "made", "again"))
        if judged.where("again").isEmpty():
            return judged.drop("again")
        attempts = judged.select("type", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    left = judged.where("again").select("type", "canon", (F.col("attempt") + 1).alias("attempt"))
    return _by_rank(left, judged.where("not again").drop("again"), real, key)


def rewrite(docs: DataFrame, key: str, text_col: str = "text", inline: int = INLINE) -> DataFrame:
    """docs with the text's entities replaced, n_entities and kinds; columns of these names are replaced."""
    own = [c for c in docs.columns if c.lower() not in ("n_entities", "kinds")]
    found = find(docs.select(*[F.col(f"`{c}`") for c in own]), text_col)
    parts = found.select(F.explode("__found").alias("x")).select(F.explode("x.parts").alias("p"))
    resolved = resolve(cut(parts.select("p.type", "p.canon").distinct()), key)
    odd = resolved.where("attempt > 0").select(F.concat_ws("|", "type", "canon").alias("entity"), "made")
    some = odd.limit(inline + 1).collect()
    if not some:
        drawn = F.lit(None).cast("map<string,string>")
    elif len(some) <= inline:
        drawn = F.create_map(*chain.from_iterable((F.lit(r.entity), F.lit(r.made)) for r in some))
    else:
        digest = F.sha2(F.col(f"`{text_col}`"), 256)
        held = found.where("__found is not null").select(digest.alias("__digest"), F.explode("__found").alias("x")).select("__digest", F.explode("x.parts").alias("p"))
        by_text = held.select("__digest", F.concat_ws("|", "p.type", "p.canon").alias("entity")).distinct().join(odd, "entity")
        maps = by_text.groupBy("__digest").agg(F.map_from_entries(F.collect_set(F.struct("entity", "made"))).alias("__drawn"))
        found = found.withColumn("__digest", digest).join(maps, "__digest", "left")
        drawn = F.col("__drawn")
    made = lambda p: F.coalesce(F.element_at(drawn, F.concat_ws("|", p["type"], p["canon"])), _surrogate(key, p["type"], p["canon"], F.lit(0)))
    new = F.transform("__found", lambda x: F.when(x["kind"].isNull(), x["raw"]).otherwise(_poured(x["raw"], x["kind"], F.transform(x["parts"], made))))
    text = F.col(f"`{text_col}`")
    between = F.split(text, PATTERN)
    joined = F.array_join(F.flatten(F.zip_with(between, new, lambda b, s: F.array(F.coalesce(b, F.lit("")), F.coalesce(s, F.lit(""))))), "")
    known = F.array_compact(F.transform("__found", lambda x: x["kind"]))
    kinds = F.array_join(F.array_sort(F.array_distinct(known)), ",")
    rewritten = F.when(F.size("__found") > 0, joined).otherwise(text).alias(text_col)
    return found.select(*[rewritten if c == text_col else F.col(f"`{c}`") for c in own], F.greatest(F.size(known), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("kinds"))


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inline: int = INLINE) -> DataFrame:
    """(doc_id, n_entities, kinds, text) for each row of docs."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rewrite(base, key, inline=inline).select("doc_id", "n_entities", "kinds", "text")


#: The registered query's key; a deployment passes its own secret.
KEY = "registered-query"


def op10_surrogates(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return surrogates(read_table(spark, sf_dir, "documents"), KEY)
