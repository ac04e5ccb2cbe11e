"""Operator 6: surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, IP addresses, card, phone, social security
and bank account numbers, hex secrets, access keys and names after a title. An
entity's canonical form (lower case, or its digits alone) draws a keyed stream, from
which a surrogate of the same type is written: letters become letters and digits
digits in the same places, so format, script and case stay; card numbers keep their
first digit and their Luhn status, phone numbers their country code, addresses
octets of 1 to 254.

Each word of a name has a surrogate of its own, a pronounceable one in the script of
the word and of the gender that most titles in the corpus give it, so 'Mr John
Smith', 'Mr Smith' and 'Dr John Smith' stay one person. A word of a name that stands
in the same text without a title, capitalised, is replaced alike.

All distinct entities of the corpus get their surrogates in one table, where
collisions are checked: with another surrogate of the type or with any real
entity. All but the first of a collision draw again, until none is left; from the
draw after WIDEN on, surrogates grow by a character (names by a syllable) each time,
so that full formats can't keep the draws going. So equal entities have equal
surrogates in all documents, and different ones differ.

Texts without a digit, an at sign, a title and the rarer marks of ``may_hold`` pass
through without a shuffle.

Defined results: a null text stays null with no entities; rows equal in
identifier and text get equal results; extra columns pass through ``replace``; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import free_name, let, written
from tessella.llm.source_mix import row_key

#: Titles by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")

_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + r")\.?"
#: Repeats of any length are possessive: Java takes those in a loop, and others by recursion.
EMAIL = r"(?<![\p{L}\p{N}_.+\-])[\p{L}\p{N}_.+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
PHONE = "|".join(
    (
        r"(?<![\w\-+(])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?!\w)",
        r"(?<![\w\-+(.])(?:\d{3}\.\d{3}\.|\d{3} \d{3} )\d{4}(?!\.?\w)",
        r"(?<![\w\-+(.])0\d{2,4}[ /]\d{6,8}(?!\.?\w)",
        r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\w)|\d{1,4}(?:[ .\-]?\d{2,4}){2,4}(?!\.?\w))",
    )
)
CARD = r"(?<![\w.\-])(?:\d{4}(?:[ \-]?\d{4}){3}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?!\w)"
SECRET = r"(?<!\w)(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9A-F]{64})(?!\w)"
KEY = r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)"
IP6 = r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"
SOCIAL = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
WORD = r"\p{Lu}[\p{L}'\-]++"
NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLE} {WORD}(?: {WORD})?"
PATTERN = "|".join((EMAIL, SECRET, KEY, IP6, IP, SOCIAL, PHONE, CARD, IBAN, NAME))
#: For texts with names: capitalised words as well.
WITH_WORDS = rf"{PATTERN}|(?<![\p{{L}}\p{{N}}]){WORD}"

#: Draws of a form before its surrogates grow.
WIDEN = 3
_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_HEX = "0123456789abcdef"
#: Consonants, vowels, and endings by gender, for names in three scripts.
_SOUNDS = {
    "latin": ("bcdfghklmnprstv", "aeiou", ("n", "s", "r", "k"), ("a", "ia", "ina", "ela")),
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу", ("н", "р", "слав", "мир"), ("а", "ия", "ина", "ана")),
    "greek": ("βγδκλμνπρστφ", "αεηιο", ("ος", "ης", "ας", "ων"), ("α", "η", "ια", "ινα")),
}


def type_of(entity: Column) -> Column:
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
        .when(entity.rlike(r"^[+(]|^\d{3}([\-. ])\d{3}\1\d{4}$|^0\d{2,4}[ /]\d{6,8}$"), "phone")
        .when(entity.rlike("^AKIA[0-9A-Z]{16}$"), "key")
        .when(entity.contains(":") & entity.rlike("^[0-9a-fA-F:]+$"), "ip6")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban")
        .when(entity.rlike(r"^[0-9a-fA-F]{40,64}$"), "secret")
        .when(entity.rlike(r"^[\d.]+$") & entity.contains("."), "ip")
        .when(entity.rlike(r"^[\d \-]+$"), "card")
        .when(entity.rlike(f"^{_TITLE} "), "name")
        .otherwise("word")
    )


def may_hold(text: Column) -> Column:
    """False only for texts without any entity: all types have a digit, a title or one of these."""
    rare = text.contains("@") | text.contains("AKIA") | text.rlike("[a-fA-F]{40}|(?:[a-fA-F]{1,4}:){7}")
    titles = text.contains(MALE[0])
    for t in (*MALE[1:], *FEMALE, *NEUTRAL):
        if not any(t != o and t.startswith(o) for o in MALE + FEMALE + NEUTRAL):
            titles = titles | text.contains(t)
    return text.rlike("[0-9]") | rare | titles


def _has_name(text: Column) -> Column:
    return text.rlike(NAME)


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, f"^({_TITLE}) ", 1)


def _gender(entity: Column) -> Column:
    title = F.regexp_replace(_title(entity), r"\.$", "")
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _words(entity: Column) -> Column:
    return F.split(F.regexp_replace(entity, f"^{_TITLE} ", ""), " ")


def canonical(kind: Column, entity: Column) -> Column:
    """What mentions of one entity have in common; phone numbers of the +1 plan are the same with and without that code."""
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when((kind == "phone") & entity.startswith("+1") & (F.char_length(digits) == 11), F.substring(digits, 2, 10))
        .when(kind.isin("card", "phone", "social"), digits)
        .when(kind == "iban", F.lower(F.regexp_replace(entity, " ", "")))
        .otherwise(F.lower(entity))
    )


def shown(kind: Column, form: Column) -> Column:
    """A form without the gender that stands before the words of names."""
    return F.when(kind == "name", F.substring(form, F.lit(3), F.char_length(form))).otherwise(form)


def _stream(secret: str, kind: Column, form: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(secret), kind, form, attempt), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shaped(form: Column, stream: Column, start: Column, end: Column, hexadecimal: bool = False) -> Column:
    """Characters from ``start`` to before ``end`` replaced within their own alphabet."""

    def one(c: Column, i: Column) -> Column:
        v = _byte(stream, i)
        new = (
            F.when(c.rlike(r"^\d$"), _pick(_LATIN[:0] + "0123456789", v))
            .when(c.rlike("^[a-z]$"), _pick(_LATIN, v))
            .when(c.rlike("^[а-яё]$"), _pick(_CYRILLIC, v))
            .when(c.rlike("^[α-ωά-ώ]$"), _pick(_GREEK, v))
            .when(c.rlike(r"^\p{L}$"), _pick(_LATIN, v))
            .otherwise(c)
        )
        return F.when((i < start) | (i >= end), c).otherwise(F.when(c.rlike("^[0-9a-f]$"), _pick(_HEX, v)).otherwise(c) if hexadecimal else new)

    return F.array_join(F.transform(_characters(form), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    n = F.char_length(digits)

    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when((n - 1 - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(_characters(digits), value), F.lit(0), lambda a, x: a + x) % 10


def _card(form: Column, stream: Column) -> Column:
    """First digit kept; the last one sets the Luhn sum that the original has."""
    n = F.char_length(form)
    body = F.concat(F.substring(_shaped(form, stream, F.lit(1), n), F.lit(1), n - 1), F.lit("0"))
    return F.concat(F.substring(body, F.lit(1), n - 1), F.pmod(_luhn(form) - _luhn(body), F.lit(10)).cast("string"))


def _octets(form: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(form, r"\."), lambda _, i: (_byte(stream, i) % 254 + 1).cast("string")), ".")


def _spoken(form: Column, stream: Column, more: Column) -> Column:
    """A word of three syllables and ``more``, with an ending of the gender, in the script of the word."""
    gender, name = F.substring(form, 1, 1), F.substring(form, F.lit(3), F.char_length(form))

    def built(script: str) -> Column:
        consonants, vowels, male, female = _SOUNDS[script]
        syllable = lambda k: F.concat(_pick(consonants, _byte(stream, 2 * k)), _pick(vowels, _byte(stream, 2 * k + 1)))
        pick = _byte(stream, F.lit(60)) % 4
        he, she = (F.get(F.array(*map(F.lit, e)), pick) for e in (male, female))
        feminine = (gender == "f") | ((gender == "n") & (_byte(stream, F.lit(61)) % 2 == 0))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), 2 + more), syllable), ""), F.when(feminine, she).otherwise(he))

    return F.when(name.rlike(r"\p{IsCyrillic}"), built("cyrillic")).when(name.rlike(r"\p{IsGreek}"), built("greek")).otherwise(built("latin"))


def surrogate(secret: str, kind: Column, form: Column, attempt: Column) -> Column:
    """Canonical surrogate of a canonical form. The stream and lengths are bound, or each character would compute them again."""
    last = F.char_length(F.substring_index(form, ".", -1))
    bound = F.struct(_stream(secret, kind, form, attempt).alias("s"), F.char_length(form).alias("n"), last.alias("last"), F.greatest(attempt - WIDEN, F.lit(0)).alias("more"))
    return let(bound, lambda x: _drawn(kind, form, x["s"], x["n"], x["n"] - x["last"] - 1, x["more"]))


def _drawn(kind: Column, form: Column, s: Column, n: Column, top: Column, more: Column) -> Column:
    """``top``: where the last label of an address starts, which stays."""
    longer = lambda alphabet: F.array_join(F.slice(F.transform(F.sequence(F.lit(1), more + 1), lambda i: _pick(alphabet, _byte(s, 63 - i))), F.lit(1), more), "")
    return (
        F.when(kind == "email", F.concat(longer(_LATIN), _shaped(form, s, F.lit(0), top)))
        .when(kind == "name", _spoken(form, s, more))
        .when(kind == "ip", _octets(form, s))
        .otherwise(
            F.concat(
                F.when(kind.isin("secret", "ip6"), _shaped(form, s, F.lit(0), n, hexadecimal=True))
                .when(kind == "key", _shaped(form, s, F.lit(4), n))
                .when(kind == "iban", _shaped(form, s, F.lit(2), n))
                .when(kind == "card", _card(form, s))
                .when(kind == "phone", _shaped(form, s, F.greatest(n - 10, F.lit(1)), n))
                .otherwise(_shaped(form, s, F.lit(0), n)),
                longer("0123456789"),
            )
        )
    )


def rendered(kind: Column, entity: Column, form: Column, new: Column) -> Column:
    """The surrogate in the layout and case of one mention; what it has beyond the form follows at the end."""
    digits = F.regexp_replace(entity, r"\D", "")
    code = F.substring(digits, F.lit(1), F.char_length(digits) - F.char_length(form))  # a country code that the form leaves out

    def laid(fill: str, skip: str, new: Column = new) -> Column:
        """Characters of ``fill`` replaced in turn; ``skip`` is everything that the canonical form leaves out."""
        place = lambda i: F.char_length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), skip, ""))
        filled = F.array_join(F.transform(_characters(entity), lambda c, i: F.when(c.rlike(fill), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")
        return F.concat(filled, F.substring(new, F.char_length(F.regexp_replace(entity, skip, "")) + 1, F.char_length(new)))

    cased = F.array_join(
        F.zip_with(_characters(new), _characters(entity), lambda c, old: F.when(F.coalesce(old.rlike(r"^\p{Lu}$"), F.lit(False)), F.upper(c)).otherwise(c)), ""
    )
    return (
        F.when(kind == "phone", laid(r"^\d$", r"\D", F.concat(code, new)))
        .when(kind.isin("card", "social"), laid(r"^\d$", r"\D"))
        .when(kind == "iban", F.upper(laid("^[A-Z0-9]$", " ")))
        .when(kind == "name", F.when(entity == F.upper(entity), F.upper(new)).otherwise(F.initcap(new)))
        .when(kind == "ip", new)
        .otherwise(cased)
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(row_key, place, part, lead, entity, kind, form, gender) of every entity in every text; names by word.

    ``lead`` is what stands before a part and stays. Texts with names also give their
    other capitalised words, as kind 'word'.
    """
    text = F.col("text")
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 0)
    found = F.when(_has_name(text), all_of(WITH_WORDS)).otherwise(all_of(PATTERN))
    rows = docs.filter(may_hold(text)).select(row_key(F.col("doc_id"), text).alias("row_key"), F.posexplode(found).alias("place", "whole"))
    rows = rows.withColumn("kind", type_of(F.col("whole")))
    named = F.col("kind") == "name"
    parts = F.posexplode(F.when(named, _words(F.col("whole"))).otherwise(F.array("whole"))).alias("part", "entity")
    rows = rows.select("row_key", "place", "kind", _title(F.col("whole")).alias("title"), _gender(F.col("whole")).alias("gender"), parts)
    lead = F.when(F.col("part") > 0, " ").when(named, F.concat("title", F.lit(" "))).otherwise("")
    return rows.select("row_key", "place", "part", lead.alias("lead"), "entity", "kind", canonical(F.col("kind"), F.col("entity")).alias("form"), "gender")


def with_names(spoken: DataFrame) -> DataFrame:
    """Words of names get their gender into their form; other words are names where their text has them in one, and else have no kind."""
    said = spoken.filter("kind = 'name'")
    lean = F.when(F.col("gender") == "m", 1).when(F.col("gender") == "f", -1).otherwise(0)
    per_text = written(said.groupBy("row_key", "form").agg(F.sum(lean).alias("lean")), "names")
    genders = per_text.groupBy("form").agg(F.sum("lean").alias("lean"))
    genders = genders.select("form", F.when(F.col("lean") > 0, "m").when(F.col("lean") < 0, "f").otherwise("n").alias("of"))
    genders = written(genders, "genders")
    words = spoken.filter("kind = 'word'").join(per_text.select("row_key", "form", F.lit("name").alias("name")), ["row_key", "form"], "left")
    words = words.withColumn("kind", F.col("name")).drop("name")
    words = said.unionByName(words).join(genders, "form", "left")
    words = words.withColumn("form", F.when(F.col("kind").isNotNull(), F.concat("of", F.lit(":"), "form"))).drop("of")
    return spoken.filter("kind not in ('name', 'word')").unionByName(words)


def assign_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, form, new) for distinct (kind, form): no two alike, none a real entity."""
    draw = surrogate(secret, F.col("kind"), F.col("form"), F.col("attempt"))
    table = written(entities.withColumn("attempt", F.lit(0)).withColumn("new", draw), "surrogates")
    real = entities.select("kind", shown(F.col("kind"), F.col("form")).alias("new")).distinct()
    while True:
        first = table.groupBy("kind", "new").agg(F.min("form").alias("owner"), F.count(F.lit(1)).alias("n"))
        taken = first.join(real.withColumn("real", F.lit(True)), ["kind", "new"], "left").filter((F.col("n") > 1) | F.col("real"))
        taken = taken.select("kind", "new", F.when(F.col("real"), F.lit(None)).otherwise(F.col("owner")).alias("owner"), F.lit(True).alias("clash"))
        taken = written(taken, "collisions")
        if taken.isEmpty():
            return table.select("kind", "form", "new")
        again = F.coalesce(F.col("clash"), F.lit(False)) & ~F.coalesce(F.col("owner") == F.col("form"), F.lit(False))
        table = table.join(taken, ["kind", "new"], "left").withColumn("attempt", F.col("attempt") + again.cast("int"))
        table = written(table.select("kind", "form", "attempt").withColumn("new", draw), "surrogates")


def replace(docs: DataFrame, secret: str, count: str | None = None) -> DataFrame:
    """docs with every entity replaced in ``text``; ``count`` names a column for the number of replaced mentions.

    Who knows ``secret`` can tell which entity a surrogate stands for, so it has no default.
    """
    spoken = written(mentions(docs).dropDuplicates(["row_key", "place", "part"]), "mentions")
    spoken = with_names(spoken)
    table = assign_surrogates(written(spoken.filter("kind is not null").select("kind", "form").distinct(), "entities"), secret)
    new = rendered(F.col("kind"), F.col("entity"), F.col("form"), F.col("new"))
    spoken = spoken.join(table, ["kind", "form"], "left").select("row_key", "place", "part", F.concat("lead", F.coalesce(new, "entity")).alias("new"), F.col("kind").isNotNull().alias("hit"))
    places = spoken.groupBy("row_key", "place").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "new")))["new"], "").alias("new"), F.max("hit").alias("hit"))
    per_row = places.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("place", "new")))["new"].alias("news"), F.count_if("hit").alias("hits"))
    per_row = written(per_row.filter("hits > 0"), "replacements")  # written, so that the join with a row that many repeat is a plain one, which Spark splits
    key, news, hits = (free_name(docs, n) for n in ("row_key__", "news__", "hits__"))
    out = [*docs.columns, hits]
    some = F.coalesce(may_hold(F.col("text")), F.lit(False))
    rows = docs.filter(some).withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    rows = rows.join(per_row.select(F.col("row_key").alias(key), F.col("news").alias(news), F.col("hits").alias(hits)), key, "left")
    pieces = F.when(_has_name(F.col("text")), F.split(F.col("text"), WITH_WORDS, -1)).otherwise(F.split(F.col("text"), PATTERN, -1))
    text = F.when(F.col(news).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(news), i), F.lit("")))), "")
    )
    rows = rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], hits)
    rows = rows.select(*out).unionByName(docs.filter(~some).withColumn(hits, F.lit(None).cast("bigint")).select(*out))
    if count:
        rows = rows.withColumn(count, F.coalesce(hits, F.lit(0)).cast("bigint"))
    return rows.drop(hits)
