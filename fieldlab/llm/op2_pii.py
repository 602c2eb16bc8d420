"""PII surrogates, in DataFrame functions only.

Entities are found by one pattern over the whole text. Each has a kind and a norm (how it is written doesn't
matter: case of addresses, separators and + or 00 of numbers). The norm gets a core by a keyed permutation of
all norms of the same format: characters are permuted within their script, case and class (vowels stay
vowels), so different norms of a format have different cores by construction. Card numbers keep their first
digit and whether the check digit is right, IBANs their country and whether the check digits are right, phones
what precedes their last ten digits, secrets their prefix;
domains keep their script and end in a reserved one. People are told by the gender of their title, their given
and their family name: the family name has one surrogate, the given name another with an ending of the same
gender. The core is written out in the entity's own format and case.

A dictionary of all norms checks the cores: where two norms of different format share one, or a core is
somebody's real norm, all but the first are permuted by another key, until all are distinct; after SAME keys,
each attempt makes the core one character longer, so there is always room. So the same entity has the same
surrogate in every document, and different ones different surrogates.

Phones are written with or without a country code in groups of 3, 3 and 4, with + or 00 and groups of any
usual length, with a leading 0 (five pairs, or an area code and 6 to 8 digits), or as 11 digits from 13 to 19 on.
Four years in a row are no card, what follows the word version no address, what follows commit, checksum or the
name of a hash no secret.

Texts without entities pass by narrowly. For the others the dictionary is joined to the distinct (text,
entity) pairs, and each text gets its own surrogates back; joins are by hash of the whole text. The
dictionary has each norm once, and so has each text its surrogates, so hot entities and copies only make one side
of a join long, which Spark splits.

Null text stays null; an empty text is empty. The noncharacter U+FDD0 in a text becomes U+FFFD. Repeated
rows are treated alike. A column named n_entities is replaced; others pass through. No pattern looks back over
more than an address of 64 characters, so a long text without blanks costs its length.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import cut, table

KEY = "fieldlab"
MARK = "﷐"
#: Keys that are tried for cores of the usual length.
SAME = 3
#: Rounds of the permutation.
ROUNDS = 6

# Patterns of the kinds, tried in this order at each place.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n"}
NAME_PART = r"\p{Lu}[\p{Ll}'’-]+"
PATTERNS = [
    r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,126}\.\p{L}{2,}",
    r"(?<![0-9A-Za-z])(?:(?<!(?i:sha-?1|sha-?256|sha-?512|md5|commit|checksum|digest)[ :=-]{1,3})(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?=(?:[ A-Z]{0,6}[0-9]){8})(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])",
    r"(?<![0-9.])(?<!(?i:version)[ :]{1,2}|(?<![0-9A-Za-z])[vV])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    r"(?<![0-9+])\+?[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9+]|[0-9][.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9+]|[0-9][.,-])(?:\+|00)(?=(?:[ ./()-]{0,3}[0-9]){7})[1-9][0-9]{0,2}(?:[ ./-]?\(?[0-9]{1,5}\)?)?(?:[ ./-]?[0-9]{2,4}){2,5}(?![0-9])",
    r"(?<![0-9+]|[0-9][.-])(?:0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})|\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{6,8})(?![0-9])",
    r"(?<![0-9+])1[3-9][0-9]{9}(?![0-9])",
    r"(?<![0-9])(?!(?:(?:19|20)[0-9]{2}[ -]){3}(?:19|20)[0-9]{2}(?![0-9]))[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<!\p{L})(?:" + "|".join(TITLES) + r")\.? " + NAME_PART + "(?: " + NAME_PART + ")?",
]
PATTERN = "|".join(PATTERNS)
#: Texts without any of this have no entity.
HINT = r"[@0-9]|(?:" + "|".join(TITLES) + r")\.? \p{Lu}"
# Endings of given names by gender.
ENDINGS = {"m": ["us", "on", "ald", "rik"], "f": ["ina", "elle", "ara", "ita"], "n": ["ey", "is", "yn", "ael"]}
# Classes of letters that are permuted among themselves.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäåæèéêëìíîïòóôöùúûü", "çñ", "ÀÁÂÄÅÆÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "ÇÑ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
HEX = ["0123456789abcdef"]
# First and last letter of scripts without case, by Unicode.
RANGES = [(0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
# Top-level domains that are reserved for tests, by script.
RESERVED = [("а-яё", "испытание"), ("α-ωά-ώ", "δοκιμή"), ("א-ת", "טעסט"), ("ء-ي", "إختبار"), ("ऄ-ह", "परीक्षा"), ("ぁ-ヺ", "テスト"), ("一-龥", "测试"), ("가-힣", "테스트")]


def kind(entity: Column) -> Column:
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
        .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(entity.rlike(r"^(?:[0-9a-fA-F]{32,128}|AKIA.*|gh[pousr]_.*|sk-.*)$"), "secret")
        .when(entity.rlike(r"^[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}"), "iban")
        .when(entity.rlike(r"^[1-9]([ -]?[0-9]){12,18}$"), "card")
        .when(entity.rlike(r"^[+(0-9]"), "phone")
        .otherwise("name")
    )


def gender(entity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.regexp_extract(entity, r"^[^ .]+", 0)), F.lit("n"))


def digits_of(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9]", "")


def norms(entity: Column, of: Column) -> Column:
    """[(kind, norm)]: what names the same thing, and for people their family name and then their given name."""
    words, one = F.split(entity, " "), lambda k, n: F.array(F.struct(k.alias("kind"), n.alias("norm")))
    family = one(F.lit("family"), F.element_at(words, -1))
    person = F.when(F.size(words) > 2, F.concat(family, one(F.concat(F.lit("given-"), gender(entity)), F.element_at(words, 2)))).otherwise(family)
    address = F.concat_ws(".", F.transform(F.split(entity, r"\."), lambda x: x.cast("int").cast("string")))
    hexes = F.when(entity.rlike("^[0-9a-fA-F]+$"), F.lower(entity)).otherwise(entity)
    name = F.when(of == "phone", F.regexp_replace(digits_of(entity), "^00", "")).when(of.isin("card", "ssn"), digits_of(entity)).when(of == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(of == "email", F.lower(entity)).when(of == "ip", address).when(of == "secret", hexes).otherwise(entity)
    return F.when(of == "name", person).otherwise(one(of, name))


def shuffled(values: str, *key: str) -> str:
    """SQL for an array of (v, size) with each v, below its size, replaced: a keyed permutation of all arrays of these sizes.

    A Feistel network: in turn the values at odd and at even places are shifted by what a keyed hash of the
    others says. A step finds the hash, the next one applies it.
    """
    turn = "i % 2 = r DIV 2 % 2"
    rest = f"array_join(transform(filter(a.l, (x, i) -> NOT {turn}), x -> concat(x.v, '/', x.size)), ',')"
    found = f"sha2(concat_ws('\\u001f', '{KEY}', {', '.join(key)}, CAST(r AS STRING), {rest}), 512)"
    shift = "CAST(conv(substring(a.h, i * 3 % 120 + 1, 6), 16, 10) AS INT)"
    moved = f"transform(a.l, (x, i) -> named_struct('v', CAST(if({turn}, (x.v + {shift}) % x.size, x.v) AS INT), 'size', x.size))"
    step = f"named_struct('h', if(r % 2 = 0, {found}, ''), 'l', if(r % 2 = 0, a.l, {moved}))"
    return f"aggregate(sequence(0, {2 * ROUNDS - 1}), named_struct('h', '', 'l', {values}), (a, r) -> {step}, a -> a.l)"


def permuted(text: str, *key: str, alphabets: list[str] = ALPHABETS) -> str:
    """SQL for text with its letters and digits replaced by others of their alphabets; other characters stay."""
    letters = "".join(alphabets)
    at, chars = f"nullif(instr('{letters}', c), 0)", f"split({text}, '')"
    first = f"element_at(array({', '.join(str(letters.index(a)) for a in alphabets for _ in a)}), {at})"
    size = f"element_at(array({', '.join(str(len(a)) for a in alphabets for _ in a)}), {at})"
    scripts = lambda f: " ".join(f"WHEN ascii(c) BETWEEN {lo} AND {hi} THEN {f(lo, hi)}" for lo, hi in RANGES)
    v = f"CAST(CASE WHEN {at} > 0 THEN {at} - 1 - {first} {scripts(lambda lo, hi: f'ascii(c) - {lo}')} ELSE 0 END AS INT)"
    of = f"CAST(CASE WHEN {at} > 0 THEN {size} {scripts(lambda lo, hi: hi - lo + 1)} ELSE 1 END AS INT)"
    out = f"CASE WHEN {at} > 0 THEN substring('{letters}', {first} + x.v + 1, 1) " + scripts(lambda lo, hi: f"decode(unhex(lpad(hex(x.v + {lo}), 4, '0')), 'UTF-16BE')") + " ELSE c END"
    values = f"transform({chars}, c -> named_struct('v', {v}, 'size', {of}))"
    return f"array_join(zip_with({chars}, {shuffled(values, *key)}, (c, x) -> {out}), '')"


def check_digit(digits: str) -> str:
    """SQL for Luhn's check digit after digits."""
    double = "CAST(c AS INT) * 2"
    each = f"transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 0, ({double}) % 10 + ({double}) DIV 10, CAST(c AS INT)))"
    return f"pmod(-aggregate({each}, 0, (a, x) -> CAST(a + x AS INT)), 10)"


def iban_digits(country: str, account: str) -> str:
    """SQL for the two check digits of an IBAN."""
    each = f"transform(split(concat({account}, {country}, '00'), ''), c -> if(c BETWEEN '0' AND '9', named_struct('v', CAST(c AS INT), 'm', 10), named_struct('v', ascii(c) - 55, 'm', 100)))"
    return f"lpad(CAST(98 - aggregate({each}, 0, (a, x) -> CAST((a * x.m + x.v) % 97 AS INT)) AS STRING), 2, '0')"


def core() -> str:
    """SQL for the surrogate of a norm, from columns kind, norm and attempt."""
    key, more = ("kind", "CAST(attempt AS STRING)"), f"greatest(attempt - {SAME - 1}, 0)"
    longer = lambda text, letter: f"concat({text}, repeat({letter}, {more}))"
    top, domain = r"substring_index(norm, '.', -1)", "substring_index(norm, '@', -1)"
    host = f"substring({domain}, 1, char_length({domain}) - char_length({top}) - 1)"
    reserved = "CASE " + " ".join(f"WHEN {top} RLIKE '[{within}]' THEN '{name}'" for within, name in RESERVED) + " ELSE 'example' END"
    email = f"concat({permuted(longer("substring_index(norm, '@', 1)", repr('a')), *key, domain)}, '@', {permuted(host, repr('domain'), top)}, '.', {reserved})"
    # The check digit's distance from the right one stays.
    head = "substring(norm, 1, 1)"
    body = f"concat({head}, {permuted(longer('substring(norm, 2, char_length(norm) - 2)', repr('0')), *key, head)})"
    card = f"transform(array({body}), b -> concat(b, CAST(pmod({check_digit('b')} + CAST(right(norm, 1) AS INT) - {check_digit('left(norm, char_length(norm) - 1)')}, 10) AS STRING)))[0]"
    country, checks, account = "left(norm, 2)", "substring(norm, 3, 2)", "substring(norm, 5)"
    iban = f"transform(array({permuted(longer(account, repr('0')), *key, country)}), b -> concat({country}, if({checks} = {iban_digits(country, account)}, {iban_digits(country, 'b')}, {permuted(checks, *key, country)}), b))[0]"
    kept = "greatest(char_length(norm) - 10, char_length(regexp_extract(norm, '^0*', 0)))"
    phone = f"concat(left(norm, {kept}), {permuted(longer(f'substring(norm, {kept} + 1)', repr('0')), *key, f'left(norm, {kept})')})"
    octets = "transform(split(norm, '[.]'), x -> named_struct('v', CAST(x AS INT), 'size', 256))"
    ip = f"concat(array_join(transform({shuffled(octets, *key)}, x -> CAST(x.v AS STRING)), '.'), if({more} > 0, concat(':', {permuted(longer(repr(''), repr('0')), *key, 'norm')}), ''))"
    prefix = "if(startswith(norm, 'sk-'), 3, 4)"
    hexes = permuted(longer("norm", repr("0")), *key, alphabets=HEX)
    secret = f"if(norm RLIKE '^[0-9a-f]+$', {hexes}, concat(left(norm, {prefix}), {permuted(longer(f'substring(norm, {prefix} + 1)', repr('a')), *key, f'left(norm, {prefix})')}))"
    own = "coalesce(nullif(regexp_extract(norm, '[а-яё]|[α-ω]', 0), ''), 'a')"
    person = permuted(longer("norm", own), *key)
    ending = "CASE kind " + " ".join(f"WHEN 'given-{g}' THEN element_at(array({', '.join(map(repr, endings))}), char_length(norm) % {len(endings)} + 1)" for g, endings in ENDINGS.items()) + " ELSE '' END"
    cases = {"email": email, "card": card, "iban": iban, "phone": phone, "ip": ip, "secret": secret, "ssn": permuted(longer("norm", repr("0")), *key)}
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {sql}" for k, sql in cases.items()) + f" ELSE concat({person}, {ending}) END"


def written(entity: Column, of: Column, surrogate: Column, given: Column) -> Column:
    """The core in the format of an entity."""
    words = F.split(entity, " ")
    name = F.concat_ws(" ", F.element_at(words, 1), given, surrogate)
    surrogate = F.when((of == "phone") & digits_of(entity).startswith("00"), F.concat(F.lit("00"), surrogate)).otherwise(surrogate)
    kept = F.when(of == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(digits_of(entity))
    place = lambda i: F.char_length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9A-Z]", ""))
    digits = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("^[0-9A-Z]$"), F.substring(surrogate, place(i), F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substring(surrogate, F.char_length(kept) + 1, F.char_length(surrogate)))
    end = F.when(of == "email", F.char_length(F.regexp_extract(entity, r"\.\p{L}+$", 0))).otherwise(0)
    like = F.split(F.substring(entity, F.lit(1), F.char_length(entity) - end), "")
    each = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.get(like, i).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    cased = F.when(entity == F.upper(entity), F.upper(surrogate)).when(entity == F.lower(entity), surrogate).otherwise(each)
    return F.when(of.isin("phone", "card", "iban", "ssn"), digits).when((of == "email") | entity.rlike("^[0-9a-fA-F]+$"), cased).when(of == "name", name).otherwise(surrogate)


def dictionary(names: DataFrame) -> DataFrame:
    """(kind, norm, core) of the distinct (kind, norm), cores distinct within a kind and nobody's norm."""
    again, made = names.select("kind", "norm").distinct(), None
    for attempt in count():
        new = again.withColumn("attempt", F.lit(attempt)).withColumn("core", F.expr(core()))
        made = cut(made.join(again, ["kind", "norm"], "left_anti").union(new) if attempt else new)
        first = made.groupBy("kind", "core").agg(F.min("norm").alias("first"), F.count("*").alias("n"))
        real = made.select("kind", F.col("norm").alias("core"), F.lit(True).alias("real"))
        clash = first.join(real, ["kind", "core"], "left").where((F.col("n") > 1) | F.col("real"))
        again = cut(made.join(clash, ["kind", "core"]).where(F.col("real") | (F.col("norm") != F.col("first"))).select("kind", "norm"))
        if again.isEmpty():
            return made.select("kind", "norm", "core")


def parts(text: Column) -> Column:
    """A text cut at its entities: plain parts at even places, entities at odd ones."""
    clean = F.replace(text, F.lit(MARK), F.lit("�"))
    return F.split(F.regexp_replace(clean, f"({PATTERN})", f"{MARK}$1{MARK}"), MARK)


def surrogates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every entity in their text replaced, and n_entities."""
    names = [c for c in docs.columns if c != "n_entities"]
    mine = F.col(f"_own.{text}")
    rows = docs.select(F.struct(*names).alias("_own"), F.when(F.col(text).rlike(HINT), parts(F.col(text))).alias("_parts"))
    out = lambda new, n: [*[new.alias(c) if c == text else F.col(f"_own.{c}").alias(c) for c in names], n.cast("long").alias("n_entities")]
    plain = rows.where(F.coalesce(F.size("_parts"), F.lit(0)) <= 1).select(*out(F.replace(mine, F.lit(MARK), F.lit("�")), F.lit(0)))
    found = rows.where(F.size("_parts") > 1).withColumn("_h", F.sha2(mine, 256))
    odd = F.filter("_parts", lambda _, i: i % 2 == 1)
    pairs = found.select("_h", F.explode(F.array_distinct(odd)).alias("entity")).distinct().withColumn("of", kind(F.col("entity")))
    pairs = cut(pairs.select("_h", "entity", "of", F.explode(norms(F.col("entity"), F.col("of"))).alias("x")).select("_h", "entity", "of", "x.*"))
    given = F.col("kind").startswith("given-")
    told = pairs.join(dictionary(pairs), ["kind", "norm"]).groupBy("_h", "entity", "of").agg(F.max(F.when(~given, F.col("core"))).alias("core"), F.max(F.when(given, F.col("core"))).alias("given"))
    told = told.select("_h", "entity", written(F.col("entity"), F.col("of"), F.col("core"), F.col("given")).alias("surrogate"))
    # Written out, so that the join below is of two plain shuffles: Spark splits the rows of a text of many copies.
    own = cut(told.groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_map")))
    new = F.array_join(F.transform("_parts", lambda x, i: F.when(i % 2 == 1, F.element_at(F.col("_map"), x)).otherwise(x)), "")
    return plain.unionByName(found.join(own, "_h").select(*out(new, (F.size("_parts") - 1) / 2)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
