"""Keyed surrogates for personal data, by column expressions alone.

Each detected entity is replaced by a value of its own type: letters by letters of the same case and
script, digits by digits, card and account numbers with valid check digits where they had them, names
by made-up names of the same gender, script and case. The replacement depends on the key, the type and
the value, so one value has one surrogate in all documents; a name found once in a document is replaced
wherever that document has it. A table of the distinct values checks that no two
values of a type share a surrogate and that no surrogate is a value of the corpus; who loses such a
collision draws again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read

#: Names whose gender is known (fixed values); surnames are found after them or after a title.
MALE = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Andrew Joshua Kenneth Kevin George Edward "
    "Stefan Klaus Hans Jürgen Wolfgang Pierre Jacques Philippe Carlos Miguel Javier Fernando Иван Сергей Дмитрий Алексей Михаил"
).split()
FEMALE = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Lisa Nancy Sandra Alice Emily Rebecca Laura "
    "Sabine Ursula Monika Petra Camille Sylvie Nathalie Carmen Lucía Pilar Анна Ольга Елена Мария Наталья"
).split()
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame"


def _either_case(names: list[str]) -> str:
    return "|".join([*names, *(n.upper() for n in names)])


_FIRST = _either_case(MALE + FEMALE)
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\x22\x27]?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Patterns of the types in the order in which they are tried at a place (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": _LABEL + r"[^\s\x22\x27,;]{6,}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    "given": rf"(?<=\b(?:{TITLES})\.? )\p{{Lu}}\p{{L}}+(?= \p{{Lu}}\p{{L}}+)",
    "surname": rf"(?=\p{{Lu}})(?:(?<=\b(?:{TITLES})\.? )|(?<=\b(?:{TITLES})\.? \p{{Lu}}\p{{L}}{{1,24}} )|(?<=\b(?:{_FIRST}) ))\p{{Lu}}\p{{L}}+",
    "male": rf"(?U)\b(?:{_either_case(MALE)})\b",
    "female": rf"(?U)\b(?:{_either_case(FEMALE)})\b",
}
NAMES = ("given", "surname", "male", "female")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_NAMES = "|".join(f"(?:{PATTERNS[n]})" for n in NAMES)
#: All types but names need one of these; most texts have none and are searched for names alone.
_MARKS = "[0-9@=:]|AKIA|ASIA"
#: Rounds of drawing again; values that still collide then get a longer surrogate.
ROUNDS = 20


def _type(value: Column) -> Column:
    """The first type whose whole pattern is the value; what stands around it is left out."""
    out = F.lit("surname")
    for name in reversed([n for n in PATTERNS if n not in ("given", "surname")]):
        bare = PATTERNS[name].replace(r"(?<![\w+])", "").replace(r"(?<![\w(])", "").replace(r"(?<![\d-])", "").replace(r"(?<![\d.])", "").replace(r"(?<![\d+])", "")
        out = F.when(value.rlike(f"^(?:{bare})$"), name).otherwise(out)
    return out


def _digest(*parts: Column) -> Column:
    """192 hex digits."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", *parts, F.lit(str(i))), 256) for i in range(3)])


def _number(digest: Column, i: Column | int, below: int) -> Column:
    """Number i (from 0, mod 48) of a digest, from 0 to below - 1."""
    at = (F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(48)) * 4 + 1).cast("int")
    return F.pmod(F.conv(F.substr(digest, at, F.lit(4)), 16, 10).cast("int"), F.lit(below))


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), (n + 1).cast("int"), F.lit(1))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CYRILLIC_LOWER, CYRILLIC_UPPER = "абвгдежзиклмнопрстуфхцч", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧ"


def _same_shape(value: Column, digest: Column, hexadecimal: Column | None = None) -> Column:
    """Each letter or digit by one of its kind; hexadecimal values stay so; all else stays."""
    plain = F.lit(False) if hexadecimal is None else hexadecimal

    def one(c: Column, i: Column) -> Column:
        draw = lambda letters: _pick(letters, _number(digest, i, len(letters)))
        return (
            F.when(c.rlike("[0-9]"), draw(DIGITS))
            .when(plain & c.rlike("[a-f]"), draw("abcdef"))
            .when(c.rlike("[a-z]"), draw(LOWER)).when(c.rlike("[A-Z]"), draw(UPPER))
            .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), draw(CYRILLIC_UPPER)).when(c.rlike(r"\p{IsCyrillic}"), draw(CYRILLIC_LOWER))
            .when(c.rlike(r"\p{Lu}"), draw(UPPER)).when(c.rlike(r"\p{Ll}"), draw(LOWER)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted once."""
    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, i.cast("int"), F.lit(1)).cast("int")
        twice = F.pmod(F.length(digits) - i, F.lit(2)) == 1
        return s + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + add(F.lit(0), i))


def _card(value: Column, shape: Column) -> Column:
    """First digit and separators stay; a valid number gets a valid check digit."""
    drawn = F.concat(F.substring(value, 1, 1), F.substr(shape, F.lit(2)))
    body = F.regexp_replace(drawn, r"\d$", "0")
    check = F.pmod(10 - F.pmod(luhn_sum(F.regexp_replace(body, "[^0-9]", "")), F.lit(10)), F.lit(10))
    valid = F.pmod(luhn_sum(F.regexp_replace(value, "[^0-9]", "")), F.lit(10)) == 0
    return F.when(valid, F.concat(F.regexp_replace(body, "0$", ""), check.cast("string"))).otherwise(drawn)


def _remainder97(text: Column) -> Column:
    """A string of digits and capital letters (A is 10, Z is 35) as a number, mod 97."""
    def add(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(s * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c.rlike("[0-9A-Z]")), F.lit(0), add)


def _iban(value: Column, shape: Column) -> Column:
    """The country stays; a valid number gets valid check digits, another one keeps its own."""
    body = F.substr(shape, F.lit(5))
    check = F.lpad((98 - _remainder97(F.concat(body, F.substring(value, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    valid = _remainder97(F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))) == 1
    return F.concat(F.substring(value, 1, 2), F.when(valid, check).otherwise(F.substring(value, 3, 2)), body)


_SYLLABLES = {False: "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve".split(), True: "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве".split()}
_ENDINGS = {"given": {False: ["ri", "lin", "rey", "ane"], True: ["и", "ша", "ля", "ня"]}, "male": {False: ["us", "rin", "mir", "ton"], True: ["ир", "он", "ей", "ан"]}, "female": {False: ["ina", "ella", "isa", "ora"], True: ["ина", "елла", "иса", "ора"]}, "surname": {False: ["sen", "mann", "lund", "well"], True: ["ский", "енко", "ов", "ин"]}}


def _name(kind: str, value: Column, digest: Column, attempt: Column) -> Column:
    """A made-up name of two syllables, one more from the third draw on, and an ending of its kind."""
    def made(cyrillic: bool) -> Column:
        syllable = lambda i: F.get(F.array(*map(F.lit, _SYLLABLES[cyrillic])), _number(digest, i, len(_SYLLABLES[cyrillic])))
        ending = F.get(F.array(*map(F.lit, _ENDINGS[kind][cyrillic])), _number(digest, 9, 4))
        return F.concat(syllable(1), syllable(2), F.when(attempt > 1, F.concat(syllable(3), syllable(4))).otherwise(""), ending)

    return F.initcap(F.when(value.rlike(r"\p{IsCyrillic}"), made(True)).otherwise(made(False)))


def drawn_for(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, value, attempt) with their surrogate at that attempt."""
    kind, value, digest, attempt, host = (F.col(c) for c in ("kind", "value", "_digest", "attempt", "_host"))
    rows = entities.select("kind", "value", "attempt").withColumn("_host", F.when(kind == "email", F.substr(value, F.instr(value, "@") + 1)))
    rows = rows.withColumns({"_digest": _digest(F.lit(key), kind, value, attempt.cast("string")), "_of_host": _digest(F.lit(key), F.lit("domain"), F.coalesce(host, F.lit("")))})
    rows = rows.withColumn("_shape", _same_shape(value, digest, (kind == "secret") & value.rlike("^[0-9a-f]+$")))
    head = F.length(F.regexp_extract(value, r"^(\+\d{1,3}|AKIA|ASIA|)", 1))  # country code or kind of key
    at = F.instr(value, "@")
    domain = _same_shape(F.regexp_extract(host, r"^(.*)\.[^.]*$", 1), F.col("_of_host"))
    mail = F.concat(F.substr("_shape", F.lit(1), at), domain, F.regexp_extract(host, r"(\.[^.]*)$", 1))
    address = F.array_join(F.transform(F.split(value, r"\."), lambda x, i: (_number(digest, i, 254) + 1).cast("string")), ".")
    new = (
        F.when(kind == "email", mail).when(kind == "ip", address).when(kind == "card", _card(value, F.col("_shape"))).when(kind == "iban", _iban(value, F.col("_shape")))
        .when(kind.isin("phone", "key"), F.concat(F.substr(value, F.lit(1), head), F.substr("_shape", head + 1)))
        .otherwise(F.col("_shape"))
    )
    for name in _ENDINGS:
        new = F.when(kind == name, _name(name, value, digest, attempt)).otherwise(new)
    return rows.select("kind", "value", "attempt", new.alias("surrogate"))


def surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, surrogate of the distinct entities(kind, value), free of collisions.

    Of the values of a kind that drew one surrogate the least keeps it; the others, and who drew a value
    of the corpus or was left as it is, draw again with the next attempt. Values whose format is full, so
    that they collide after so many rounds, keep the last draw with sixteen hex digits of their own added.
    """
    real = durable(entities.select("kind", "value").distinct())
    drawn = durable(drawn_for(real.select("*", F.lit(0).alias("attempt")), key))
    for _ in range(rounds):
        winners = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("w"), F.count("*").alias("n"))
        beaten = drawn.join(winners.where("n > 1"), ["kind", "surrogate"]).where(F.struct("attempt", "value") != F.col("w")).select("kind", "value")
        taken = drawn.join(real.select(F.col("value").alias("surrogate")).distinct(), "surrogate", "left_semi").select("kind", "value")
        again = durable(beaten.unionByName(taken).distinct())
        if again.isEmpty():
            return drawn.select("kind", "value", "surrogate")
        redrawn = drawn.join(again, ["kind", "value"], "left_semi").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        drawn = durable(drawn.join(again, ["kind", "value"], "left_anti").unionByName(drawn_for(redrawn, key)))
    own = F.concat("surrogate", F.lit("-"), F.substring(_digest(F.lit(key), F.lit("overflow"), F.col("kind"), F.col("value")), 1, 16))
    full = drawn.join(again, ["kind", "value"], "left_semi").withColumn("surrogate", own)
    return drawn.join(again, ["kind", "value"], "left_anti").unionByName(full).select("kind", "value", "surrogate")


def pseudonymised(docs: DataFrame, key: str, found: str = "n_entities") -> DataFrame:
    """docs with its own columns, text with surrogates for personal data, and the number of entities.

    Null texts stay null; texts without entities stay as they are and are not shuffled; repeated rows
    get equal texts. A label before a secret, and a title before a name, stays. A name in capitals gets
    the surrogate of the same name in capitals. A column of docs named like the count is replaced by it.
    """
    columns = [c for c in docs.columns if c != found]
    names = [f"`{c}`" for c in columns]
    hit = F.coalesce(F.when(F.col("text").rlike(_MARKS), F.col("text").rlike(ANY)).otherwise(F.col("text").rlike(_NAMES)), F.lit(False))
    rest = docs.where(~hit).select(*names, F.lit(0).cast("long").alias(found))
    all_of = lambda name: F.regexp_extract_all("_t", F.lit(PATTERNS[name]), F.lit(0))
    parts = docs.where(hit).select(F.struct(*names).alias("_d"), F.col("text").alias("_t"))
    parts = parts.select("_d", "_t", F.array_distinct(all_of("given")).alias("_given"), all_of("surname").alias("_known"))
    parts = parts.withColumn("_known", F.array_distinct(F.concat("_known", "_given")))
    parts = parts.withColumn("_known", F.array_distinct(F.concat("_known", F.transform("_known", F.upper))))
    # Names of the document are letters alone, so they are patterns of themselves.
    own = F.concat(F.lit(ANY + r"|(?U)\b(?:"), F.array_join("_known", "|"), F.lit(r")\b"))
    pattern = F.when(F.size("_known") == 0, F.lit(ANY)).otherwise(own)
    parts = parts.select("_d", "_given", F.regexp_extract_all("_t", pattern, F.lit(0)).alias("_m"), F.split("_t", pattern).alias("_g"))
    parts = durable(parts.withColumn("_row", F.monotonically_increasing_id()))
    matches = parts.select("_row", "_given", F.posexplode("_m").alias("_at", "_x"))
    label = F.regexp_extract("_x", f"^({_LABEL})", 1)
    kind = _type(F.col("_x"))
    kind = F.when((kind == "surname") & F.array_contains("_given", F.col("_x")), "given").otherwise(kind)
    entity = matches.select("_row", "_at", kind.alias("kind"), F.when(kind == "secret", label).otherwise("").alias("_label"), "_x")
    entity = entity.select("_row", "_at", "kind", "_label", F.substr("_x", F.length("_label") + 1).alias("value"))
    name = F.col("kind").isin(*NAMES)
    capitals = name & (F.length("value") > 1) & (F.col("value") == F.upper("value"))
    entity = durable(entity.withColumns({"_capitals": capitals, "value": F.when(name, F.initcap("value")).otherwise(F.col("value"))}))
    new = F.concat("_label", F.when(F.col("_capitals"), F.upper("surrogate")).otherwise(F.col("surrogate")))
    mapped = entity.join(surrogates(entity, key), ["kind", "value"]).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", new.alias("s")))).alias("_s"))
    joined = parts.select("_row", "_d", "_g").join(mapped, "_row")
    text = F.array_join(F.transform("_g", lambda g, i: F.concat(g, F.coalesce(F.get("_s", i)["s"], F.lit("")))), "")
    done = joined.select(*[(text if c == "text" else F.col("_d").getField(c)).alias(c) for c in columns], F.size("_s").cast("long").alias(found))
    return rest.unionByName(done)


#: For the registered query and the pipeline; a deployment passes its own secret.
DEMONSTRATION_KEY = "kinvec-demonstration"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), DEMONSTRATION_KEY)
    return out.select("doc_id", "n_entities", "text")
