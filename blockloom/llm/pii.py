"""PII surrogates, by DataFrame and SQL functions only (operator 1).

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards, social security numbers, IBANs,
access keys, tokens and passwords, names after a form of address, and the same names wherever else the text
has them, in the same or in capital letters. Each entity has a normal form (case, spaces and punctuation
aside; case counts in secrets that aren't hexadecimal; phone numbers with their country, +1 where a number of
ten digits names none), so that all its spellings get one surrogate everywhere. A surrogate comes from a keyed
hash (HMAC) of type and normal form and keeps the type's format: digits stay digits, hexadecimal stays
hexadecimal in its own case, a card that passes the check-digit test passes it again, names keep script, case
and the gender of their form of address, if it has one. Surrogates are compared with one another and with all
originals of their type; whoever clashes draws again, until none does, so that different entities stay
different and none becomes another. Where a format has no room left, the entities still without a surrogate
take one another's places.

Not detected: names that no form of address is before in their text; cards of other than 16 digits without a
fitting check digit; letters outside Latin, Cyrillic and Greek script become Latin ones.

Documents without any trace of an entity take no part in a join. Of the others only the text moves, once.

Cases. Null text: stays null. Empty text: stays. Null or repeated doc_id and repeated rows: each row for
itself, with the same surrogates. Very long texts: whole. Empty table: no rows. Other columns stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The key where the session sets none (spark.blockloom.surrogateKey) and none is given.
KEY = "surrogates-1"
#: Draws after which a format counts as full; each draw after the second has far more room.
MOST_DRAWS = 40

#: Forms of address by gender (fixed values).
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Г-жа", "Госпожа")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "Доктор", "Профессор")
_FORMS = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
#: Short forms that are no words of their own: they count in any case, before a name in any case.
_SHORT = "(?i:mrs?|dr|prof)"
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: Letters of a name that is looked for elsewhere in its text, at least.
LEAST_BARE = 3

#: What a secret follows, in any case; the patterns look at it only behind a sign that may end it, which is quick.
_SECRET = r"""(?i:token|secret|passw(?:or)?d|pwd|api_?key)\s?[=:]"""

#: A secret whose case doesn't count, and account numbers that are hexadecimal too, by their countries.
HEX_SECRET = r"^(?:[0-9a-f]+|[0-9A-F]+|[0-9A-Fa-f]{18,64})$"
HEX_IBAN = r"^(?:(?:AE|BA|BE|DE|EE)\d{14,21}|AD\d{10}[0-9A-F]{12})$"

#: What an entity looks like; at one place the first pattern that fits wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62}\.){1,8}\p{L}{2,24}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "access": r"\b(?:AKIA|ASIA)[A-Z0-9]{12,16}\b",
    "phone": r"(?<![\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}\b|(?<![\p{N}.])00[1-9]\d{0,2}[ .-]\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}\b|(?<!\p{N})\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\b\d{3}[ .-]\d{3}[ .-]\d{4}\b",
    "ip": r"(?<![\p{N}.vV])(?<!(?i:version|release|build)[ :=]{1,2})(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\p{N})",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}(?:[ -]\d{4}){3}\b|\b\d{13,19}\b",
    "secret": rf"""(?<=[=:\s"'])(?<=[=:]\s?["']?)(?<={_SECRET}\s?["']?)[A-Za-z0-9+/_-]{{8,}}|\b(?=[A-Fa-f]{{0,63}}\d)[0-9A-Fa-f]{{18,64}}\b""",
    "name": rf"(?<!\p{{L}})(?:(?:{_FORMS})\.? {_NAME}|{_SHORT}\.? \p{{L}}[\p{{L}}'’-]*\p{{L}})(?: {_NAME}){{0,2}}(?!\p{{L}})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Whatever lacks this has no entity: a cheap first look.
TRACE = rf"[0-9@]|[=:](?<={_SECRET})|(?:{_FORMS})\.? \p{{Lu}}|(?<!\p{{L}}){_SHORT}\.? \p{{L}}"

_SYLLABLES = {
    "latin": ("ba", "be", "co", "da", "de", "fa", "go", "ha", "jo", "ka", "ke", "la", "le", "lo", "ma", "mi", "mo", "na", "ne", "no", "pa", "pe", "ra", "ri", "ro", "sa", "se", "ta", "te", "to", "va", "vi"),
    "cyrillic": ("ба", "бе", "ко", "да", "де", "фа", "го", "ха", "жо", "ка", "ке", "ла", "ле", "ло", "ма", "ми", "мо", "на", "не", "но", "па", "пе", "ра", "ри", "ро", "са", "се", "та", "те", "то", "ва", "ви"),
}


def _letters(first: str, count: int) -> str:
    return "".join(chr(ord(first) + i) for i in range(count))


def _byte(place: str) -> str:
    """SQL for the hash byte of a place counted from 1; `h` holds 128 hexadecimal digits."""
    return f"cast(conv(substr(h, 2 * (({place} - 1) % 64) + 1, 2), 16, 10) as int)"


def _pick(choices: str, place: str) -> str:
    """SQL for one character of a string, by the hash byte of a place."""
    return f"substr('{choices}', {_byte(place)} % {len(choices)} + 1, 1)"


def _scrambled(text: str, shift: str = "0", letters: str = _letters("a", 26)) -> str:
    """SQL for a string of the same classes of characters."""
    c, at = f"substr({text}, i, 1)", f"i + {shift}"
    return (
        f"array_join(transform(if(length({text}) > 0, sequence(1, length({text})), array()), i -> CASE "
        f"WHEN {c} BETWEEN '0' AND '9' THEN {_pick('0123456789', at)} "
        f"WHEN {c} BETWEEN 'a' AND 'z' THEN {_pick(letters, at)} "
        f"WHEN {c} BETWEEN 'A' AND 'Z' THEN {_pick(letters.upper(), at)} "
        f"WHEN {c} BETWEEN 'а' AND 'я' THEN {_pick(_letters('а', 32), at)} "
        f"WHEN {c} BETWEEN 'α' AND 'ω' THEN {_pick(_letters('α', 17), at)} "
        f"WHEN {c} rlike '[\\\\p{{L}}]' THEN {_pick(letters, at)} ELSE {c} END), '')"
    )


def _renumbered(text: str, shift: str) -> str:
    """SQL for a string with other digits, its other characters kept."""
    return f"array_join(transform(if(length({text}) > 0, sequence(1, length({text})), array()), i -> IF(substr({text}, i, 1) BETWEEN '0' AND '9', {_pick('0123456789', f'i + {shift}')}, substr({text}, i, 1))), '')"


def _luhn_sum(digits: str) -> str:
    """SQL for the check-digit sum of a string of digits whose last digit counts once."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + IF(i % 2 = 0, {d}, IF({d} > 4, 2 * {d} - 9, 2 * {d})))"


def _syllables(script: str, places: range) -> str:
    each = ", ".join(f"'{s}'" for s in _SYLLABLES[script])
    return "concat(" + ", ".join(f"element_at(array({each}), {_byte(str(p))} % 32 + 1)" for p in places) + ")"


def _name(script: str) -> str:
    """SQL for a name of a script: longer after the second draw, with the ending of its gender."""
    ending = {"latin": ("n", "a", "l", "ner"), "cyrillic": ("н", "а", "л", "нко")}[script]
    stem = f"CASE WHEN draw < 2 THEN {_syllables(script, range(1, 4))} ELSE {_syllables(script, range(1, 6))} END"
    return f"concat({stem}, CASE kind WHEN 'given_m' THEN '{ending[0]}' WHEN 'given_f' THEN '{ending[1]}' WHEN 'given' THEN '{ending[2]}' ELSE '{ending[3]}' END)"


def surrogate() -> str:
    """SQL for the surrogate's normal form, from kind, norm, draw and the hash h."""
    local, domain = "substring_index(norm, '@', 1)", "substring_index(norm, '@', -1)"
    more = f"IF(draw < 2, '', concat({_pick('0123456789', '61')}, {_pick('0123456789', '62')}, {_pick('0123456789', '63')}, {_pick('0123456789', '64')}))"
    host = f"IF({domain} rlike '(^|[.])example[.](com|org|net)$', concat({_renumbered(f'substr({domain}, 1, length({domain}) - 11)', '40')}, right({domain}, 11)), concat('mail', {_pick('0123456789', '58')}, {_pick('0123456789', '59')}, '.example.', IF({domain} rlike '[.](com|org|net)$', right({domain}, 3), 'org')))"
    card = f"concat(substr(norm, 1, 1), {_scrambled('substr(norm, 2)')})"
    checked = f"concat(substr({card}, 1, length(norm) - 1), cast((10 - ({_luhn_sum(f"concat(substr({card}, 1, length(norm) - 1), '0')")}) % 10) % 10 as string))"
    country = "CASE WHEN norm like '+1%' THEN 2 WHEN norm like '+%' THEN 3 ELSE 0 END"
    rest = f"substr(norm, {country} + 1)"
    fiction = f"IF(draw < 2 AND substr({rest}, 4, 3) = '555', concat({_scrambled(f'substr({rest}, 1, 3)')}, '555', {_scrambled(f'substr({rest}, 7)', '10')}), {_scrambled(rest)})"
    octet = lambda place: f"cast({_byte(str(place))} % 254 + 1 as string)"
    return f"""CASE kind
      WHEN 'email' THEN concat({_scrambled(local)}, {more}, '@', {host})
      WHEN 'phone' THEN concat(substr(norm, 1, {country}), {fiction})
      WHEN 'ip' THEN concat_ws('.', IF(draw < 2, '10', {octet(1)}), {octet(2)}, {octet(3)}, {octet(4)})
      WHEN 'card' THEN IF(({_luhn_sum("norm")}) % 10 = 0, {checked}, {card})
      WHEN 'ssn' THEN concat('9', {_scrambled("substr(norm, 2)")})
      WHEN 'iban' THEN concat(substr(norm, 1, 2), {_scrambled("substr(norm, 3)")})
      WHEN 'access' THEN concat(substr(norm, 1, 4), {_scrambled("substr(norm, 5)")})
      WHEN 'secret' THEN IF(norm rlike '^[0-9a-f]+$', {_scrambled("norm", letters="abcdef")}, {_scrambled("norm")})
      ELSE IF(norm rlike '[\\\\p{{IsCyrillic}}]', {_name("cyrillic")}, {_name("latin")}) END"""


def _kind(value: Column) -> Column:
    """The type of a found entity."""
    fits = lambda pattern: value.rlike(pattern)
    return (
        F.when(value.contains("@"), "email")
        .when(fits(rf"^(?:{_FORMS}|{_SHORT})\.? \p{{L}}"), "name")
        .when(fits(r"^(AKIA|ASIA)[A-Z0-9]{12,16}$"), "access")
        .when(fits(r"^(?=\d*[A-F])[0-9A-F]{8,64}$") & ~fits(HEX_IBAN), "secret")
        .when(fits(r"^[A-Z]{2}\d{2} ?[A-Z0-9]{4}"), "iban")
        .when(fits(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(fits(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(fits(r"^(\d{13,19}|\d{4}([ -]\d{4}){3})$"), "card")
        .when(fits(r"^[+(]|^00[1-9]\d{0,2}[ .-]|^\d{3}[ .-]\d{3}[ .-]\d{4}$"), "phone")
        .otherwise("secret")
    )


def _parts(value: Column, kind: Column) -> Column:
    """What of a value has a surrogate of its own: (kind, norm) in order; the words of a name apart."""
    words = F.split(value, " ")
    form = F.lower(F.regexp_replace(words[0], r"\.$", ""))
    gender = F.when(form.isin(*(f.lower() for f in MALE)), "given_m").when(form.isin(*(f.lower() for f in FEMALE)), "given_f").otherwise("given")
    named = F.transform(F.slice(words, 2, 9), lambda w, i: F.struct(F.when(i == F.size(words) - 2, F.lit("surname")).otherwise(gender).alias("kind"), F.lower(w).alias("norm")))
    digits = F.regexp_replace(F.regexp_replace(value, "^00", "+"), r"[^0-9+]", "")
    phone = F.when(digits.startswith("+"), digits).otherwise(F.concat(F.lit("+1"), digits))
    plain = F.when(kind == "email", F.lower(value)).when(kind.isin("card", "ssn"), F.regexp_replace(value, r"\D", "")).when(kind == "phone", phone).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when((kind == "secret") & value.rlike(HEX_SECRET), F.lower(value)).otherwise(value)
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), plain.alias("norm"))))


def _counts(value: Column, kind: Column) -> Column:
    """Whether a value that looks like an entity is taken for one: a card of other than 16 digits needs a fitting check digit."""
    digits = F.regexp_replace(value, r"\D", "")
    return (kind != "card") | (F.length(digits) == 16) | _luhn_fits(digits)


def _luhn_fits(digits: Column) -> Column:
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    digit = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i)))
    return total % 10 == 0


def _cased(word: str, drawn: str) -> str:
    """SQL for a name's surrogate in the case of the name."""
    return f"CASE WHEN {word} = upper({word}) THEN upper({drawn}) WHEN {word} = lower({word}) THEN {drawn} ELSE initcap({drawn}) END"


def _rendered(value: str, kind: str, drawn: str) -> str:
    """SQL for a value's surrogate in the value's own spelling, from its parts' surrogates in order."""
    # of a phone number's surrogate, what the value spells: with + and country, with 00 and country, or without
    whole = f"CASE WHEN {kind} <> 'phone' OR {value} like '+%' THEN {drawn}[0] WHEN {value} like '00%' THEN concat('00', substr({drawn}[0], 2)) ELSE substr({drawn}[0], 3) END"
    spelled = f"""aggregate(split({value}, ''), named_struct('out', '', 'at', 1), (s, c) ->
        IF(c rlike '[0-9A-Za-z+]', named_struct('out', concat(s.out, substr({whole}, s.at, 1)), 'at', s.at + 1), named_struct('out', concat(s.out, c), 'at', s.at)), s -> s.out)"""
    cased = f"array_join(transform(sequence(1, length({value})), i -> IF(substr({value}, i, 1) BETWEEN 'A' AND 'Z', upper(substr({drawn}[0], i, 1)), substr({drawn}[0], i, 1))), '')"
    named = f"concat_ws(' ', concat(array(split({value}, ' ')[0]), transform({drawn}, (d, i) -> {_cased(f"split({value}, ' ')[i + 1]", 'd')})))"
    return f"CASE WHEN {kind} = 'name' THEN {named} WHEN {kind} IN ('card', 'ssn', 'phone', 'iban') THEN {spelled} WHEN {kind} = 'secret' THEN {cased} ELSE {drawn}[0] END"


def keyed_hash(message: Column, key: str) -> Column:
    """HMAC-SHA-512 as 128 hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def draw_surrogates(entities: DataFrame, key: str = KEY, most_draws: int = MOST_DRAWS) -> DataFrame:
    """Rows (kind, norm, surrogate) for distinct (kind, norm): no two alike within a kind, none an original.

    Entities that clash after most_draws draws, their format being full, get one another's normal forms in turn
    within a format; these are nobody else's surrogates. One alone in its format is blanked.
    """
    now = entities.withColumn("draw", F.lit(0))
    originals = cut(entities.select(F.col("kind").alias("kind"), F.col("norm").alias("surrogate")))
    for nth in range(most_draws):
        hashed = keyed_hash(F.concat_ws("\x1f", "kind", "norm", "draw"), key)
        drawn = now.withColumn("h", hashed).withColumn("surrogate", F.expr(surrogate())).select("kind", "norm", "draw", "surrogate")
        among = Window.partitionBy("kind", "surrogate").orderBy("draw", "norm")
        taken = originals.withColumn("taken", F.lit(True))
        ranked = drawn.join(taken, ["kind", "surrogate"], "left").withColumn("nth", F.row_number().over(among))
        now = cut(ranked.withColumn("clash", F.col("taken").isNotNull() | (F.col("nth") > 1)).drop("taken", "nth"))
        if not now.agg(F.max("clash").alias("any")).first()["any"]:
            return now.select("kind", "norm", "surrogate")
        if nth < most_draws - 1:
            now = now.select("kind", "norm", (F.col("draw") + F.col("clash").cast("int")).alias("draw"))
    left = now.where("clash").withColumn("format", F.regexp_replace(F.regexp_replace("norm", r"\d", "0"), r"\p{L}", "x"))
    turn = Window.partitionBy("kind", "format").orderBy(keyed_hash(F.concat_ws("\x1f", "kind", "norm"), key), "norm")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.coalesce(F.lead("norm").over(turn), F.first("norm").over(whole))
    rest = left.select("kind", "norm", F.when(moved == F.col("norm"), F.col("format")).otherwise(moved).alias("surrogate"))
    return cut(now.where("NOT clash").select("kind", "norm", "surrogate").union(rest))


#: Words of a text, and what is between them.
_TOKEN = r"[\p{L}'’-]+|[^\p{L}'’-]+"


def _bare(map_: Column) -> Column:
    """Pairs (word, new) for a text's names, as they are and in capitals, from its map of found values."""
    names = F.filter(F.map_entries(map_), lambda e: e["key"].rlike(rf"^(?:{_FORMS}|{_SHORT})\.? \p{{L}}"))
    words = lambda value: F.slice(F.split(value, " "), 2, 9)
    pairs = F.flatten(F.transform(names, lambda e: F.zip_with(words(e["key"]), words(e["value"]), lambda w, n: F.struct(F.initcap(w).alias("word"), F.initcap(n).alias("new")))))
    long = F.filter(pairs, lambda p: F.length(p["word"]) >= LEAST_BARE)
    both = F.array_sort(F.concat(long, F.transform(long, lambda p: F.struct(F.upper(p["word"]).alias("word"), F.upper(p["new"]).alias("new")))))
    # a word under two forms of address has the surrogate that comes first
    return F.map_from_entries(F.filter(both, lambda p, i: (i == 0) | (F.get(both, i - 1)["word"] != p["word"])))


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with surrogates in place of entities, and n_entities, how many were replaced.

    All columns stay; n_chars follows the text where the table has it. A table's own n_entities stays as it is.
    """
    key = key or docs.sparkSession.conf.get("spark.blockloom.surrogateKey", KEY)
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").alias("__text"))
    traced = F.coalesce(F.col("__text").rlike(TRACE), F.lit(False))
    found = F.regexp_extract_all("__text", F.lit(ENTITY), F.lit(0))
    suspects = packed.where(traced).withColumn("found", found).withColumn("text_key", F.when(F.size("found") > 0, F.md5("__text")))
    values = cut(suspects.select("text_key", F.explode(F.array_distinct("found")).alias("value")).distinct())
    typed = values.select("text_key", "value", _kind(F.col("value")).alias("type"))
    parted = typed.where(_counts(F.col("value"), F.col("type"))).withColumn("part", _parts(F.col("value"), F.col("type")))
    drawn = draw_surrogates(parted.select(F.explode("part").alias("p")).select("p.kind", "p.norm").distinct(), key)
    spellings = parted.select("value", "type", F.posexplode("part").alias("at", "p")).select("value", "type", "at", "p.kind", "p.norm").distinct()
    rendered = (
        spellings.join(drawn, ["kind", "norm"])
        .groupBy("value", "type")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda s: s["surrogate"]).alias("drawn"))
        .select("value", F.expr(_rendered("value", "type", "drawn")).alias("new"))
    )
    by_text = values.join(rendered, "value", "left").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("value", "new")))).alias("map"))
    by_text = by_text.withColumn("bare", _bare(F.col("map")))
    new_text = lambda gap: F.array_join(F.zip_with("gaps", "found", lambda g, value: F.concat(gap(g), F.coalesce(F.col("map")[value], value, F.lit("")))), "")
    tokens = lambda g: F.regexp_extract_all(g, F.lit(_TOKEN), F.lit(0))
    renamed = lambda g: F.array_join(F.transform(tokens(g), lambda t: F.coalesce(F.col("bare")[t], t)), "")
    with_names = F.size("bare") > 0
    repeats = F.aggregate("gaps", F.lit(0).cast("long"), lambda n, g: n + F.size(F.filter(tokens(g), lambda t: F.col("bare")[t].isNotNull())))
    replaced = F.size(F.filter("found", lambda v: F.col("map")[v].isNotNull())).cast("long")
    joined = suspects.where(F.size("found") > 0).join(by_text, "text_key").withColumn("gaps", F.split("__text", ENTITY, -1))
    hit = joined.select("row", F.when(with_names, new_text(renamed)).otherwise(new_text(lambda g: g)).alias("__text"), (replaced + F.when(with_names, repeats).otherwise(0)).alias("__n"))
    rest = packed.where(~traced).select("row", "__text", F.lit(0).cast("long").alias("__n")).union(suspects.where(F.size("found") == 0).select("row", "__text", F.lit(0).cast("long")))
    changed = {"text": F.col("__text"), "n_chars": F.coalesce(F.when(F.col("__n") > 0, F.char_length("__text")), F.col("row.n_chars") if "n_chars" in names else F.lit(None)).cast("long")}
    return hit.union(rest).select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names), *([] if "n_entities" in names else [F.col("__n").alias("n_entities")]))
