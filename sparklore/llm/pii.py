"""Personal data: keyed, type-consistent surrogates; DataFrame functions only.

One pattern finds e-mail addresses, secrets, card, phone, social and network numbers, street addresses, and names with a title
or a common given name. A mention is read as one or two canonical entities: a mailbox folds case, a number is its digits
(without the country's), a name its surname and its given name, whatever the title. Every distinct entity of the whole
corpus gets one surrogate from a keyed hash, which each mention shows in its own format: letters stay letters of the same case
and script, digits digits, punctuation stays; card numbers keep their Luhn validity, given names their gender. So mentions
of one entity read alike (coreference). A collision check over all surrogates and all entities sends losers to their next
attempt, which has more room, until surrogates are distinct and equal no real entity.

Null texts stay null; empty texts, texts without entities and repeated rows pass unchanged or alike. Extra columns pass under
any names; where one is called n_entities or entity_kinds it is returned as ``<name>_input``.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shielded, small, with_possible

#: Titles by gender and script; others tell no gender.
TITLES = {
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña"),
    "m_cyrillic": ("господин", "Господин"),
    "f_cyrillic": ("госпожа", "Госпожа"),
    "": ("Dr", "Prof", "Professor", "Doctor", "Dra"),
}
#: Surrogate given names.
GIVEN = {
    "m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon"),
    "f": ("Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Ida", "Julia", "Karla", "Lena"),
    "m_cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    "f_cyrillic": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
}
#: Common given names that mark a name without a title.
KNOWN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Peter", "Paul", "Hans", "Klaus", "Jürgen", "Stefan", "Wolfgang", "Pierre", "Jean", "Michel", "François", "Luc", "José", "Juan", "Carlos", "Luis", "Miguel", "Antonio"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Anna", "Alice", "Ursula", "Monika", "Sabine", "Petra", "Marie", "Sophie", "Camille", "Nathalie", "María", "Carmen", "Ana", "Isabel", "Lucía"),
}
SYLLABLES = ("bal", "cor", "den", "fal", "gar", "hol", "jar", "kel", "lin", "mor", "nev", "pol", "ran", "sol", "tam", "vor")
SYLLABLES_CYRILLIC = ("бал", "вор", "ген", "дар", "зор", "кал", "лин", "мор", "нев", "пол", "ран", "сол", "там", "фед", "хол", "яр")
ALPHABETS = (("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{IsCyrillic}&&\p{Ll}", "абвгдежзиклмнопрстуфхцчшэюя"))
#: Words that say what kind of street it is.
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square", "Terrace", "Place")
STREET_ENDS = ("straße", "strasse", "weg", "platz", "allee", "gasse")
CALLES = ("Calle", "Avenida", "Plaza", "Paseo")

_titles = "|".join(t for group in TITLES.values() for t in sorted(group, key=len, reverse=True))
_known = "|".join(n for group in KNOWN.values() for n in group)
_word = r"\p{Lu}[\p{L}'-]+"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?=[0-9a-f])(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9-])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9-])|(?<![0-9])[0-9]{13,19}(?![0-9])"
NUMBERED = rf"(?<![0-9.,-])[0-9]{{1,5}},?[ ](?:(?:{_word}[ ]){{1,3}}(?:{'|'.join(STREETS)})(?!\p{{L}})|(?:rue|avenue|boulevard|chemin)[ ](?:(?:de|du|des|la|le)[ ])*{_word})"
STREET = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:\p{{Lu}}\p{{Ll}}{{2,}}(?<={'|'.join(STREET_ENDS)})|(?:{'|'.join(CALLES)})[ ](?:(?:de|del|la|los|las)[ ])*{_word},?)[ ][0-9]{{1,4}}(?![0-9])"
NAME = rf"(?=[\p{{Lu}}г])(?<!\p{{L}})(?:(?:{_titles})\.?[ ]{_word}(?:[ ]{_word})?|(?:{_known})[ ]{_word})"
ENTITY = "|".join((EMAIL, SECRET, rf"(?=[0-9(+])(?:{'|'.join((ADDRESS, SOCIAL, CARD, PHONE, NUMBERED))})", STREET, NAME))
#: Types in the order in which a mention is tried.
TYPES = (("email", EMAIL), ("secret", SECRET), ("address", ADDRESS), ("social", SOCIAL), ("card", CARD), ("phone", PHONE), ("street", f"{NUMBERED}|{STREET}"), ("name", NAME))


def mentions_in(text: Column) -> Column:
    """All mentions in a text from left to right."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def mention_type(mention: Column) -> Column:
    return reduce(lambda rest, kind: F.when(mention.rlike(f"^(?:{kind[1]})$"), kind[0]).otherwise(rest), reversed(TYPES), F.lit("name"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def national(mention: Column) -> Column:
    """A phone number's digits without the country's: one digit before ten others, else two after a plus sign."""
    digits = _digits(mention)
    without = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when(F.length(digits) == 10, digits)
    return without.when(mention.startswith("+"), F.substring(digits, 3, 99)).otherwise(digits)


def _name_parts(mention: Column) -> tuple[Column, Column, Column, Column]:
    """Title, given name (or null), surname and group (gender and script) of a name."""
    title = F.regexp_extract(mention, rf"^((?:{_titles})\.?) ", 1)
    names = F.split(F.regexp_replace(mention, rf"^(?:{_titles})\.? ", ""), " ")
    given, surname = F.when(F.size(names) > 1, F.get(names, F.lit(0))), F.get(names, F.size(names) - 1)
    bare = F.regexp_replace(title, r"\.$", "")
    female = bare.isin(*TITLES["f"], *TITLES["f_cyrillic"]) | (bare.isin("", *TITLES[""]) & F.coalesce(given.isin(*KNOWN["f"], *GIVEN["f"], *GIVEN["f_cyrillic"]), F.lit(False)))
    return title, given, surname, F.concat(F.when(female, "f").otherwise("m"), F.when(surname.rlike(r"\p{IsCyrillic}"), "_cyrillic").otherwise(""))


def entities(mention: Column, kind: Column) -> Column:
    """The canonical entities of a mention: an array of (slot, kind, key)."""
    _, given, surname, group = _name_parts(mention)
    script = F.regexp_extract(group, "(_cyrillic|)$", 1)
    entry = lambda slot, what, key: F.struct(F.lit(slot).alias("slot"), what.alias("kind"), key.alias("key"))
    key = F.when(kind == "email", F.lower(mention)).when(kind == "phone", national(mention)).when(kind.isin("card", "social"), _digits(mention)).otherwise(mention)
    family, first = entry("last", F.concat(F.lit("surname"), script), surname), entry("first", F.concat(F.lit("given_"), group), given)
    return F.when(kind != "name", F.array(entry("whole", kind, key))).when(given.isNull(), F.array(family)).otherwise(F.array(first, family))


def _stream(key: str, entity: Column, attempt: int) -> Column:
    """Keyed hex digits for an entity: two for each of its characters, and for as many more as attempts may add."""
    seedling = F.concat(F.lit(key + "\x1f"), entity, F.lit(f"\x1f{attempt}"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(entity) + attempt + 8) / 32).cast("int")), lambda k: F.sha2(F.concat(seedling, F.lit("\x1f"), k.cast("string")).cast("binary"), 256)), "")


def _number(stream: Column, at: Column | int) -> Column:
    """The 8-bit number at position ``at`` of a stream."""
    return F.conv(F.substring(stream, F.lit(2) * at + 1, F.lit(2)), 16, 10).cast("int")


def _characters(entity: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter and digit replaced by another of its class."""

    def swap(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        out = F.when(hexadecimal, F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1))).when(c.rlike("[0-9]"), (n % 10).cast("string"))
        for pattern, letters in ALPHABETS:
            out = out.when(c.rlike(pattern if pattern.startswith("[") else f"[{pattern}]"), F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), swap), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last one not doubled."""
    reversed_digits = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(reversed_digits, F.lit(0), lambda acc, x: acc + x)


def _card(digits: Column, swapped: Column) -> Column:
    """``swapped`` with its last digit set so that it passes Luhn's check, where ``digits`` pass it."""
    body = F.concat(swapped.substr(F.lit(1), F.length(swapped) - 1), F.lit("0"))
    check = ((10 - _luhn_sum(body) % 10) % 10).cast("string")
    return F.when(_luhn_sum(digits) % 10 == 0, F.concat(swapped.substr(F.lit(1), F.length(swapped) - 1), check)).otherwise(swapped)


def _street(street: Column, stream: Column) -> Column:
    """Digits and names of a street replaced, the words that say what it is kept."""
    ends, kept = "|".join(STREET_ENDS), "|".join((*STREETS, *CALLES))

    def swap(word: Column, i: Column) -> Column:
        other = lambda x: _characters(x, F.substring(stream, 8 * i + 1, F.lit(999)), F.lit(False))
        long = word.rlike(f"({ends})$")
        return F.when(word.rlike(rf"^(?:(?:{kept}),?|\p{{Ll}}+)$"), word).when(long, F.concat(other(F.regexp_replace(word, f"({ends})$", "")), F.regexp_extract(word, f"({ends})$", 1))).otherwise(other(word))

    return F.array_join(F.transform(F.split(street, " "), swap), " ")


def _pick(choices: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, choices)), n % len(choices))


def surrogate(entity: Column, kind: Column, attempt: int, key: str) -> Column:
    """The surrogate of a canonical entity at an attempt: a function of the key alone. Later attempts have more room: names get
    another syllable each, and from the eighth attempt on numbers and addresses get another character each."""
    stream = _stream(key, F.concat(kind, F.lit("\x1f"), entity), attempt)
    more = "".join("x" for _ in range(max(0, attempt - 7)))
    spare = _characters(F.lit(more.replace("x", "0")), F.reverse(stream), F.lit(False)) if more else F.lit("")
    swapped = _characters(entity, stream, kind == "secret")
    address = F.concat_ws(":", F.array_join(F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: (_number(stream, k) % 254 + 1).cast("string")), "."), *([spare] if more else []))
    top = F.regexp_extract(entity, r"(\.[a-z]+)$", 1)
    email = F.concat(spare, _characters(F.regexp_replace(entity, r"\.[a-z]+$", ""), stream, F.lit(False)), top)
    out = F.when(kind == "address", address).when(kind == "email", email).when(kind == "card", F.concat(_card(entity, swapped), spare)).when(kind == "street", F.concat(_street(entity, stream), spare))
    for group, names in GIVEN.items():
        syllables = SYLLABLES_CYRILLIC if group.endswith("cyrillic") else SYLLABLES
        added = F.concat(*[_pick(syllables, _number(stream, k)) for k in range(1, attempt + 1)], F.lit("") if group[0] == "m" else F.lit("а" if group.endswith("cyrillic") else "a")) if attempt else F.lit("")
        out = out.when(kind == f"given_{group}", F.concat(_pick(names, _number(stream, 0)), added))
    for script, syllables in (("", SYLLABLES), ("_cyrillic", SYLLABLES_CYRILLIC)):
        out = out.when(kind == f"surname{script}", F.initcap(F.concat(*[_pick(syllables, _number(stream, k)) for k in range(3 + attempt)])))
    return out.otherwise(F.concat(swapped, spare))


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """(kind, key, surrogate), one row per distinct entity of the checkpointed ``found`` (kind, key); distinct in each kind."""
    settled, open_rows = None, found
    for attempt in itertools.count():
        tried = open_rows.withColumn("surrogate", surrogate(F.col("key"), F.col("kind"), attempt, key))
        # among rows with one surrogate the least entity wins, unless the surrogate is taken or is itself a real entity
        winners = tried.groupBy("kind", "surrogate").agg(F.min("key").alias("key"))
        taken = found.select("kind", F.col("key").alias("surrogate"))
        taken = taken if settled is None else taken.union(settled.select("kind", "surrogate"))
        placed = winners.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "key", "surrogate")
        settled = checkpointed(placed if settled is None else settled.unionByName(placed))
        open_rows = found.join(settled, ["kind", "key"], "left_anti")
        if open_rows.isEmpty():
            return settled


def _in_format(mention: Column, digits: Column) -> Column:
    """The digits of a mention replaced from left to right; those in front that ``digits`` do not reach stay, spare ones follow."""
    kept = F.greatest(F.lit(0), F.length(_digits(mention)) - F.length(digits))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        new = F.when(digit & (acc["n"] >= kept), F.substring(digits, acc["n"] - kept + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["n"] + digit.cast("int")).alias("n"))

    return F.aggregate(F.split(mention, ""), state, step, lambda acc: F.concat(acc["out"], F.substring(digits, acc["n"] - kept + 1, F.lit(99))))


def rendered(mention: Column, kind: Column, found: Column) -> Column:
    """A mention's replacement in its own format; ``found`` maps slots to surrogates."""
    title, given, _, _ = _name_parts(mention)
    whole = F.element_at(found, F.lit("whole"))
    name = F.concat(F.when(title == "", "").otherwise(F.concat(title, F.lit(" "))), F.when(given.isNull(), "").otherwise(F.concat(F.element_at(found, F.lit("first")), F.lit(" "))), F.element_at(found, F.lit("last")))
    cased = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(whole, i + 1, F.lit(1)))).otherwise(F.substring(whole, i + 1, F.lit(1)))), "")
    email = F.when((F.lower(mention) == mention) | (F.length(whole) != F.length(mention)), whole).otherwise(cased)
    return F.when(kind == "name", name).when(kind == "email", email).when(kind.isin("phone", "card", "social"), _in_format(mention, whole)).otherwise(whole)


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, kind, replacement), checkpointed, of every distinct ``mention``."""
    typed = checkpointed(mentions.select("mention").distinct().withColumn("kind", mention_type(F.col("mention"))))
    parts = typed.select("mention", F.col("kind").alias("type"), F.explode(entities(F.col("mention"), F.col("kind"))).alias("e")).select("mention", "type", "e.slot", "e.kind", "e.key")
    known = surrogate_table(checkpointed(parts.select("kind", "key").distinct()), key)
    found = parts.join(small(known), ["kind", "key"]).groupBy("mention", "type").agg(F.map_from_entries(F.collect_list(F.struct("slot", "surrogate"))).alias("found"))
    return checkpointed(found.select("mention", F.col("type").alias("kind"), rendered(F.col("mention"), F.col("type"), F.col("found")).alias("replacement")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the columns n_entities and entity_kinds (the kind of each mention, in order).

    The pattern runs over all texts once. Its mentions, with a hash of their row, are kept; a Bloom filter of bounded size
    over these hashes tells the other rows, which pass as they are, from those that meet their replacements.
    """
    inner, names = shielded(docs)
    row = F.xxhash64("doc_id", "text")
    mentions = checkpointed(inner.select(row.alias("_row"), F.explode(F.array_distinct(mentions_in(F.col("text")))).alias("mention")))
    known = replacements(mentions, key)
    pairs = mentions.distinct().join(small(known), "mention")
    # rows of one hash share the map: a mention is replaced alike everywhere
    maps = checkpointed(pairs.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("mention", F.struct("replacement", "kind")))).alias("_map")))
    parted = with_possible(inner.withColumn("_at_row", row), F.col("_at_row"), maps, "_row")
    touched = parted.filter("_possible").join(maps, F.col("_at_row") == F.col("_row"), "left")
    split = touched.withColumn("_both", F.explode(F.array(F.struct(mentions_in(F.col("text")).alias("parts"), F.split("text", f"(?:{ENTITY})", -1).alias("gaps")))))
    parts, gaps = F.col("_both.parts"), F.col("_both.gaps")
    swapped = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(parts, lambda e, i: F.concat(F.element_at("_map", e)["replacement"], F.get(gaps, i + 1))), ""))
    kinds = F.array_join(F.array_sort(F.transform(parts, lambda e: F.element_at("_map", e)["kind"])), ",")
    hit = F.col("_map").isNotNull() & (F.size(parts) > 0)
    n, what = F.when(hit, F.size(parts)).otherwise(0).cast("long").alias("n_entities"), F.when(hit, kinds).otherwise("").alias("entity_kinds")
    done = split.select(*[F.when(hit, swapped).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in inner.columns], n, what)
    rest = parted.filter("not _possible").select(*inner.columns, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds"))
    out = [f"{old}_input" if old in ("n_entities", "entity_kinds") else old for _, old in names]
    return done.unionByName(rest).toDF(*out, "n_entities", "entity_kinds")
