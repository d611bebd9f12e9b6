"""Surrogates for personal data: detected entities get keyed replacements of the same type, gender, script and format.

Everything is Spark expressions. A mention is what the pattern finds in a text; it holds one or more tokens, and equal
tokens (after case and separators are taken away) are one entity, wherever they occur. Entities get surrogates from a
keyed hash; a surrogate that another entity has, or that is itself an entity of the corpus, is drawn again, so
different entities stay different and equal ones equal. Where a format has values set aside for examples, surrogates
are taken from those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import last_staged, staged, staged_folders, wrapped

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_END = r"(?![\p{L}\p{N}])"
#: Titles by the gender that they tell.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа", "κυρία"),
    "": ("Dr", "Prof"),
}
#: Given names by gender and script. A given name is replaced by another of its own list.
GIVEN = (
    ("James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "William", "Richard", "Charles", "George", "Daniel", "Andrew", "Hans", "Klaus", "Jürgen", "Sven", "Pierre", "Jean", "Louis", "Xavier", "Carlos", "José", "Miguel", "Pedro", "Marco", "Luca", "Ahmed", "Omar", "Ali", "Wei", "Raj"),
    ("Mary", "Anna", "Linda", "Susan", "Karen", "Laura", "Julia", "Emma", "Elizabeth", "Jennifer", "Patricia", "Barbara", "Margaret", "Sarah", "Greta", "Heike", "Ursula", "Ingrid", "Marie", "Claire", "Chloé", "Sophie", "Carmen", "Lucía", "Sofía", "Elena", "Maria", "Giulia", "Fatima", "Aisha", "Mei", "Priya"),
    ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"),
    ("Мария", "Ольга", "Ирина", "Наталья", "Екатерина", "Светлана"),
    ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"),
    ("Ελένη", "Κατερίνα", "Σοφία", "Γεωργία"),
)
#: Words that make a place or a thing of the name before them, and words that make one of the name after them.
PLACES = ("River", "Street", "Road", "Avenue", "Lane", "Drive", "Cathedral", "Church", "School", "University", "College", "Hospital", "Island", "Islands", "Lake", "Bay", "Park", "Hill", "Bridge", "County", "City", "Airport", "Station", "Museum", "Hall", "Square", "Valley", "Beach", "Prize", "Award")
SAINTS = ("St", "St.", "Saint", "San", "Santa", "Lake", "Mount", "Fort", "Port")
#: What stands before a name where it is given.
CONTEXTS = ("name is", "Name:", "name:", "Dear", "Signed,", "signed,", "Sincerely,", "Regards,", "regards,", "Attn:")
#: Lengths of account numbers (IBAN) by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "SI", 20: "AT EE LT LU", 21: "CH HR LV", 22: "BG DE GB IE RS", 23: "AE IL", 24: "CZ ES RO SA SE SK",
    25: "PT", 26: "TR", 27: "FR GR IT", 28: "CY HU PL", 29: "BR UA", 31: "MT",
}
#: Country codes of telephone numbers of one and two digits; all others have three.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

_NAME = r"\p{Lu}(?:\p{L}++(?:['’\-]\p{L}++)*+|['’]\p{Lu}\p{L}++)"
_TITLE = "(?:" + "|".join(v for group in TITLES.values() for t in group for v in dict.fromkeys((t, t.capitalize()))) + r")\.?"
_LISTED = "|".join(n for g in GIVEN for n in g)
_IS_PLACE = f"(?:{'|'.join(PLACES)}){_END}"
_NOT_SAINT = "".join(rf"(?<!{x} )".replace(".", r"\.") for x in SAINTS)
_DATE = r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{4})(?![0-9])"
_STREET = "Street|Avenue|Road|Lane|Drive|Boulevard|Square|Terrace"

#: In the order in which they are tried at a place.
PATTERNS = {
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]*?-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]*+",
    "login": r"(?<=://)[^\s/:@]+:[^\s/@]+(?=@)",
    "email": r"[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "secret": r"""(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)["']?\s{0,3}[:=]\s{0,3}["']?(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{8,}+""",
    "cloud_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _END,
    "iban": "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()) + ")" + _END,
    "hex": r"(?=[a-f]*+[0-9])[0-9a-f]{32,}+" + _END,
    "ipv6": r"(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "phone": r"(?:\+(?=(?:[ .\-()]{0,2}[0-9]){7})[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,6}|\(?[0-9]{3}\)?[ .\-][0-9]{3,4}[ .\-][0-9]{3,4})(?![0-9])",
    "birth": rf"(?i:born(?: on)?|date of birth|birth date|dob|geboren am|née? le)\s?:?\s{_DATE}",
    "address": rf"[0-9]{{1,5}} (?:{_NAME} ){{1,2}}(?:{_STREET}){_END}",
    "person": rf"(?=\p{{L}})(?:{_TITLE} {_NAME}(?: {_NAME})?|{_NOT_SAINT}(?:{_LISTED}) (?!{_IS_PLACE}){_NAME}(?! {_IS_PLACE})|(?:{'|'.join(f'(?<={c} )' for c in CONTEXTS)}){_NAME} {_NAME})",
}
_START = r"(?<![\p{L}\p{N}])"
#: Usual forms of a card, looked for from every place; in any other form it is looked for where the last one ended, as in a
#: table of numbers a tenth of all places would begin one.
USUAL = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])"
_SEPARATOR = r"[^\p{L}\p{N}]"

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"
_CYRILLIC_VOWELS, _CYRILLIC_CONSONANTS = "аеиоу", "бвгдзклмнпрстфх"
_GREEK_VOWELS, _GREEK_CONSONANTS = "αειου", "βγδζθκλμνπρστφχ"
_HAN = "安白陈方高何江李林马孙王吴徐杨张"


def _keyed(key: str, *parts: Column) -> Column:
    """HMAC with SHA-512 of the parts, as 128 hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat_ws("\x1f", *parts), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def _number(stream: Column, at: int) -> Column:
    """Byte ``at`` (from 0) of a hexadecimal stream."""
    return F.conv(F.substring(stream, 2 * at + 1, 2), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _letters(c: Column, n: Column) -> Column:
    """A character of the same class: digit, case and script."""
    latin = "abcdefghijklmnopqrstuvwxyz"
    return (
        F.when(c.rlike("[0-9]"), _pick("0123456789", n))
        .when(c.rlike("[A-Z]"), _pick(latin.upper(), n))
        .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC_VOWELS + _CYRILLIC_CONSONANTS, n))
        .when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK_VOWELS + _GREEK_CONSONANTS, n))
        .when(c.rlike(r"\p{L}"), _pick(latin, n))
        .otherwise(c)
    )


def _name_letters(c: Column, n: Column) -> Column:
    """Lower case; vowels stay vowels, so that what comes out can be said."""
    return (
        F.when(c.rlike("[aeiouyáéíóúàèìòùâêîôûäëïöüæœãõå]"), _pick(_VOWELS, n))
        .when(c.rlike("[аеёиоуыэюя]"), _pick(_CYRILLIC_VOWELS, n))
        .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC_CONSONANTS, n))
        .when(c.rlike("[αεηιουωάέήίόύώ]"), _pick(_GREEK_VOWELS, n))
        .when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK_CONSONANTS, n))
        .when(c.rlike(r"\p{IsHan}"), _pick(_HAN, n))
        .when(c.rlike(r"\p{L}"), _pick(_CONSONANTS, n))
        .otherwise(c)
    )


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _each(text: Column, stream: Column, swap: Callable[[Column, Column], Column]) -> Column:
    """Each character by a byte of the stream; both are cut up once, so that a long key costs what its length says."""
    bytes_ = F.slice(F.regexp_extract_all(stream, F.lit(".."), F.lit(0)), F.lit(1), F.length(text))
    return F.array_join(F.zip_with(_chars(text), bytes_, lambda c, h: swap(c, F.conv(h, 16, 10).cast("int"))), "")


def _stream(key: str, length: Column, *parts: Column) -> Column:
    blocks = F.sequence(F.lit(0), F.floor(length / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: _keyed(key, *parts, b.cast("string"))), "")


def _luhn_sum(digits: Column) -> Column:
    """Of digits that a check digit will follow."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b)


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def _mod97(account: Column) -> Column:
    """The remainder by which an account number is judged: letters count as 10 to 35, the first four characters stand last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    worth = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.transform(_chars(turned), worth), F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _host(norm: Column, stream: Column, longer: Column) -> Column:
    """A domain set aside for examples, with as many labels: under example.com, .net and .org, else under .example."""
    top = F.substring_index(norm, ".", -1)
    below = F.substring(norm, F.lit(1), F.length(norm) - F.length(top) - 1)
    label = F.substring_index(below, ".", -1)
    sub = F.substring(below, F.lit(1), F.length(below) - F.length(label) - 1)
    free = F.when(top.isin("com", "net", "org") & (F.length(sub) > 0), sub).otherwise(below)
    new = F.concat(_each(free, stream, _letters), longer)
    return F.when(top.isin("com", "net", "org"), F.concat(new, F.lit(".example."), top)).otherwise(F.concat(new, F.lit("."), top, F.lit(".example")))


def _other_date(key: str, norm: Column) -> Column:
    """Year, month and day turned by steps of the key, one to one; what may be a month stays one that may be."""
    steps = _keyed(key, F.lit("date"))
    turn = [_number(steps, k) for k in range(3)]

    def one(part: Column, i: Column) -> Column:
        n, step = part.cast("int"), F.element_at(F.array(*turn), i + 1)
        low = (n - 1 + step % 11 + 1) % 12 + 1
        high = F.when(n <= 28, (n - 13 + step % 15 + 1) % 16 + 13).otherwise(n)
        moved = F.when(F.length(part) == 4, n - 1 - turn[2] % 9).when(n <= 12, low).otherwise(high)
        wide = F.greatest(F.length(part), F.length(moved.cast("string")))
        return F.lpad(moved.cast("string"), wide, F.lit("0"))

    numbers = F.regexp_extract_all(norm, F.lit("[0-9]+"), F.lit(0))
    between = F.concat(F.regexp_extract_all(norm, F.lit("[^0-9]+"), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.transform(numbers, one), between, lambda n, x: F.concat(n, x)), "")


#: Kinds whose tokens are one entity only if they are equal to the character; their surrogates keep every other character.
EXACT = ("secret", "jwt", "hex", "cloud_key", "ip", "date")


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """For an entity in its normal form; later attempts give others, and from the fourth on longer ones."""
    tries = attempt.cast("string")
    stream = _stream(key, F.length(norm), kind, norm, tries)
    longer = F.when(attempt >= 3, F.substring(F.translate(stream, "abcdef", "012345"), F.lit(1), F.least(attempt - 2, F.lit(12)))).otherwise("")

    # addresses of networks that reach no one stay in theirs; others become addresses that no one has
    private = norm.rlike(r"^(?:10|127|172|192|169|0)\.")
    octets = [_number(stream, k) for k in range(4)]
    first = F.when(private, F.substring_index(norm, ".", 1)).when(attempt < 3, (octets[0] % 15 + 240).cast("string")).otherwise((octets[0] % 99 + 11).cast("string"))
    second = F.when(private & norm.rlike(r"^(?:172|192|169)\."), F.element_at(F.split(norm, r"\."), 2)).otherwise(octets[1].cast("string"))
    ip = F.concat_ws(".", first, second, octets[2].cast("string"), octets[3].cast("string"))
    ipv6 = F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.substring(stream, 4 * k + 1, 4)) for k in range(6)))

    body = F.concat(F.substring(norm, 1, 1), _each(F.substring(norm, F.lit(2), F.length(norm) - 2), stream, _letters))
    card = F.concat(body, _check_digit(body))
    account = F.concat(F.substring(norm, 1, 2), F.lit("00"), _each(F.substring(norm, F.lit(5), F.length(norm)), stream, _letters))
    iban = F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(account)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(account)))

    hexed = _each(norm, stream, lambda c, n: F.when(c.rlike("[0-9]"), _pick("0123456789", n)).otherwise(_pick("abcdef", n)))
    plain = _each(norm, stream, _letters)
    kept = lambda n: F.concat(F.substring(norm, F.lit(1), n), F.substring(plain, n + 1, F.length(plain)))
    code = F.length(F.regexp_extract(norm, f"^(?:{CALLING})", 0))
    area, group, serial = ((_number(stream, 2 * k) * 256 + _number(stream, 2 * k + 1)) for k in range(3))
    area = area % 898 + 1
    ssn = F.concat(F.lpad((area + (area >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((group % 99 + 1).cast("string"), 2, "0"), F.lpad((serial % 9999 + 1).cast("string"), 4, "0"))
    last = F.substring(norm, -1, 1)
    name = _each(norm, stream, _name_letters)
    stem = F.substring(name, F.lit(1), F.length(name) - 1)
    script = lambda latin, cyrillic, greek: F.when(norm.rlike(r"\p{IsCyrillic}"), cyrillic).when(norm.rlike(r"\p{IsGreek}"), greek).otherwise(latin)
    name = F.when(kind == "name_f", F.concat(stem, script("a", "а", "α"))).when(kind == "name_m", F.concat(stem, script("n", "н", "ς"))).when(
        last.rlike("[aeiouáéíóúаеиоуяαειουηως]"), F.concat(stem, last)
    ).otherwise(name)

    out = F.when(kind == "domain", _host(norm, stream, longer)).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card)
    out = out.when(kind == "cloud_key", kept(F.lit(4))).when(kind == "jwt", kept(F.lit(3))).when(kind == "iban", iban)
    out = out.when(kind == "phone", F.concat(kept(F.lit(1)), longer)).when(kind == "phone_abroad", F.concat(kept(code), longer)).when((kind == "ssn") & (attempt < 8), ssn)
    out = out.when(kind == "house", F.concat((octets[0] % 9 + 1).cast("string"), F.substring(plain, F.lit(2), F.length(plain)), longer))
    out = out.when(kind.startswith("name"), F.concat(name, F.translate(longer, "0123456789", "aeioulmnrs")))
    out = out.when(kind.startswith("given"), _other_given(key, kind, norm)).when(kind == "date", _other_date(key, norm))
    return out.otherwise(F.concat(F.when(norm.rlike("^[0-9a-f]+$"), hexed).otherwise(plain), longer))


def _other_given(key: str, kind: Column, norm: Column) -> Column:
    """A rotation of the name's own list: one to one by construction."""
    out = F.lit(None).cast("string")
    for k, names in enumerate(GIVEN):
        low = F.array(*(F.lit(n.lower()) for n in names))
        turn = _number(_keyed(key, F.lit(f"given{k}")), 0) % (len(names) - 1) + 1
        out = F.when(kind == f"given{k}", F.element_at(low, ((F.array_position(low, norm) - 1 + turn) % len(names) + 1).cast("int"))).otherwise(out)
    return out


def _kind(mention: Column) -> Column:
    """By the first pattern that the whole mention fits; what is before or after it in a text has done its work."""
    whole = {k: p for k, p in PATTERNS.items() if k not in ("login", "person")} | {"login": r"[^\s/:@]+:[^\s/@]+"}
    out = F.lit("person")
    for name, pattern in reversed(whole.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _name_kind(word: Column, first_of_two: Column, gender: Column) -> Column:
    """Listed given names by their list; others by the title before them, where that tells the gender."""
    out = F.when(first_of_two & (gender != ""), F.concat(F.lit("name_"), gender)).otherwise(F.lit("name"))
    for k, names in enumerate(GIVEN):
        out = F.when(F.lower(word).isin(*(n.lower() for n in names)), f"given{k}").otherwise(out)
    return F.when(word.rlike(f"^{_TITLE}$"), None).otherwise(out)


def _gender(mention: Column) -> Column:
    title, out = F.lower(F.regexp_replace(F.substring_index(mention, " ", 1), r"\.", "")), F.lit("")
    for gender in ("m", "f"):
        out = F.when(title.isin(*(t.lower() for t in TITLES[gender])), gender).otherwise(out)
    return out


def tokens(mentions: DataFrame) -> DataFrame:
    """(mention, at, kind, raw, norm): a mention in pieces that joined give it back; pieces without a kind stay as they are."""
    piece = lambda kind, raw: F.struct((F.lit(kind) if kind is None or isinstance(kind, str) else kind).cast("string").alias("kind"), raw.alias("raw"))
    m, n = F.col("mention"), F.length("mention")

    def tail(kind: str, end: str) -> Column:
        value = F.regexp_extract(m, end, 0)
        return F.array(piece(None, F.substring(m, F.lit(1), n - F.length(value))), piece(kind, value))

    cut = F.split(m, "(?<= )|(?= )")
    gender, count = _gender(m), F.size(cut)
    names = F.transform(cut, lambda w, i: piece(F.when(w != " ", _name_kind(w, i < count - 1, gender)), w))
    streets = F.transform(cut, lambda w, i: piece(F.when(i == 0, F.lit("house")).when((w != " ") & (i < count - 1), F.lit("name")), w))
    user, at = F.substring_index(m, ":", 1), F.substring_index(m, "@", 1)
    login = F.array(piece("secret", user), piece(None, F.lit(":")), piece("secret", F.substring(m, F.length(user) + 2, n)))
    email = F.array(piece("mailbox", at), piece(None, F.lit("@")), piece("domain", F.substring_index(m, "@", -1)))
    header, footer = F.regexp_extract(m, "^-----BEGIN [A-Z ]*-----", 0), F.regexp_extract(m, "-----END [A-Z ]*-----$", 0)
    pem = F.array(piece(None, header), piece("secret", F.substring(m, F.length(header) + 1, n - F.length(header) - F.length(footer))), piece(None, footer))

    kind = F.col("type")
    pieces = F.when(kind == "secret", tail("secret", r"[A-Za-z0-9+/_\-]+$")).when(kind == "birth", tail("date", f"{_DATE}$")).when(kind == "login", login)
    pieces = pieces.when(kind == "email", email).when(kind == "pem", pem).when(kind == "person", names).when(kind == "address", streets)
    pieces = pieces.when((kind == "phone") & m.startswith("+"), F.array(piece("phone_abroad", m))).otherwise(F.array(piece(kind, m)))
    each = mentions.withColumn("type", _kind(m)).select("mention", F.posexplode(pieces).alias("at", "p")).filter("p.raw <> ''")
    raw, kind = F.col("p.raw"), F.col("p.kind")
    lower = kind.isin("mailbox", "domain", "ipv6") | kind.startswith("given") | kind.startswith("name")
    norm = F.when(lower, F.lower(raw)).when(kind.isin(*EXACT), raw).otherwise(F.regexp_replace(raw, _SEPARATOR, ""))
    return each.select("mention", "at", kind.alias("kind"), raw.alias("raw"), norm.alias("norm"))


def _rendered(kind: Column, raw: Column, new: Column) -> Column:
    """The surrogate in the mention's own separators and case; what is longer than the mention follows at its end."""

    def at(i: Column) -> Column:
        c = F.substring(raw, i, F.lit(1))
        k = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), _SEPARATOR, ""))
        s = F.substring(new, k, F.lit(1))
        return F.when(c.rlike(_SEPARATOR), c).otherwise(s)

    walked = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), at), "")
    walked = F.when(raw.rlike(_SEPARATOR), walked).otherwise(F.substring(new, F.lit(1), F.length(raw)))
    used = F.length(F.regexp_replace(raw, _SEPARATOR, ""))
    walked = F.concat(walked, F.substring(new, used + 1, F.length(new)))
    is_name = kind.startswith("given") | kind.startswith("name")
    cased = F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(new)).otherwise(F.initcap(new))
    mail = F.when((raw == F.upper(raw)) & raw.rlike("[A-Z]"), F.upper(new)).otherwise(new)
    return F.when(is_name, cased).when(kind.isin("mailbox", "domain"), mail).when(kind.isin(*EXACT, "ipv6"), new).otherwise(walked)


def settled(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, new): a surrogate per entity, all different inside a kind and none of them an entity itself.

    Of entities that draw the same surrogate the smallest keeps it and the others draw again. Later draws are longer,
    so this ends. Given names and dates turn among themselves, one to one, and need no check.
    """
    given = F.col("kind").startswith("given") | (F.col("kind") == "date")
    # entities are few bytes and much work each: more partitions than their size alone would give
    entities = staged(entities.repartition(2 * entities.sparkSession.sparkContext.defaultParallelism), "entities")
    own = entities.select("kind", F.col("norm").alias("new"))
    drawn = lambda rows, attempt: rows.select("kind", "norm", surrogate(key, F.col("kind"), F.col("norm"), F.lit(attempt)).alias("new"))
    done, pending, attempt = drawn(entities.filter(given), 0), entities.filter(~given), 0
    while True:
        candidates = staged(drawn(pending, attempt), "drawn")
        free = candidates.join(own, ["kind", "new"], "left_anti").join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        done = staged(done.unionByName(free.groupBy("kind", "new").agg(F.min("norm").alias("norm"))), "surrogates")
        pending = staged(candidates.join(done, ["kind", "norm"], "left_anti").select("kind", "norm"), "pending")
        if pending.isEmpty():
            return done
        attempt += 1


def _valid(card: Column) -> Column:
    digits = F.regexp_replace(card, "[^0-9]", "")
    return _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1)


def _alternatives(text: Column, gate: str, found: Column) -> Column:
    """What was found, the longer of two that begin alike first, as part of a pattern; nothing where the gate is not passed."""
    own = F.reverse(F.array_sort(F.array_distinct(found)))
    return F.when(text.rlike(gate) & (F.size(own) > 0), F.array_join(own, "|")).otherwise("(?!)")


def pattern(text: Column) -> Column:
    """What to search ``text`` with. Digits are a card, and letters and digits an account, only if their check digits are
    right, which no pattern can tell: the text's own cards and accounts stand in the pattern, and at others the search
    goes on to the kinds that follow. The last words of the text's persons stand there too, so that they are found alone.
    """
    every = lambda p, group=1: F.regexp_extract_all(text, F.lit(p), F.lit(group))
    cards = F.filter(F.flatten(F.array(every(f"{_START}({PATTERNS['card']})"), every(f"{_START}(?=({USUAL}))"))), _valid)
    accounts = F.filter(every(f"{_START}({PATTERNS['iban']})"), lambda x: _mod97(F.regexp_replace(x, " ", "")) == 1)
    names = F.transform(every(f"{_START}({PATTERNS['person']})"), lambda x: F.substring_index(x, " ", -1))
    person = f"{_START}{PATTERNS['person']}"
    own = {
        "card": F.concat(F.lit("(?=[0-9])(?:"), _alternatives(text, _START + PATTERNS["card"], cards), F.lit(")(?![0-9])")),
        "iban": F.concat(F.lit("(?=[A-Z])(?:"), _alternatives(text, _START + PATTERNS["iban"], accounts), F.lit(f"){_END}")),
    }
    each = [own[k] if k in own else F.lit(p) for k, p in PATTERNS.items()]
    each.append(F.concat(F.lit(r"(?=\p{Lu})(?:"), _alternatives(text, person, F.filter(names, lambda x: F.length(x) > 2)), F.lit(f"){_END}")))
    return F.concat(F.lit(f"{_START}(?:"), F.concat_ws("|", *each), F.lit(")"))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, t, mention): what each document holds, once each."""
    found = docs.select("doc_id", F.xxhash64("text").alias("t"), F.array_distinct(F.regexp_extract_all("text", pattern(F.col("text")), F.lit(0))).alias("found"))
    return found.select("doc_id", "t", F.explode("found").alias("mention"))


def replace(docs: DataFrame, *, key: str) -> DataFrame:
    """Documents with ``text`` in surrogates, and ``n_entities``, the mentions replaced.

    docs: doc_id, text and any other columns; a column named n_entities is replaced. Null texts stay null, texts
    without a mention stay as they are; a very long text is searched as a whole, and keys and secrets of any length are
    replaced whole. The same key gives the same surrogates for the same corpus. Rows equal in id and text get equal
    results. An empty table gives an empty result.

    Persons are found by a title, by a listed given name, or where a text says that a name follows; after that by their
    last word alone in the same text. ``key`` stands in the plan: keep it from logs by spark.sql.redaction.string.regex.
    """
    if not key:
        raise ValueError("surrogates need a key")
    before = staged_folders()
    held = staged(mentions(docs).distinct(), "mentions")
    pieces = staged(tokens(held.select("mention").distinct()), "tokens")
    new = settled(pieces.filter("kind is not null").select("kind", "norm").distinct(), key)
    rendered = pieces.join(new, ["kind", "norm"], "left")
    rendered = rendered.withColumn("out", F.when(F.col("kind").isNull(), F.col("raw")).otherwise(_rendered(F.col("kind"), F.col("raw"), F.col("new"))))
    whole = rendered.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("at", "out"))).alias("parts"))
    whole = staged(whole.select("mention", F.array_join(F.col("parts.out"), "").alias("out")), "rendered")
    per_doc = held.join(whole, "mention").groupBy("doc_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("mention", "out"))).alias("map"))
    per_doc = last_staged(per_doc, "replacements", before).withColumnRenamed("doc_id", "id")
    keyed = wrapped(docs, "doc_id", F.xxhash64("text").alias("own"))
    both = keyed.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("t")), "left")
    touched, old = F.col("map").isNotNull(), F.col("row").getField("text")
    found = F.when(touched, F.regexp_extract_all(old, pattern(old), F.lit(0)))
    between = F.when(touched, F.split(old, pattern(old), -1))
    both = both.withColumns({"found": found, "between": between})
    put = F.zip_with("between", F.concat("found", F.array(F.lit(""))), lambda gap, m: F.concat(gap, F.coalesce(F.element_at("map", m), m)))
    text = F.when(touched, F.array_join(put, "")).otherwise(old).alias("text")
    replaced = F.filter("found", lambda m: F.map_contains_key("map", m))
    kept = {c: F.col("row").getField(c).alias(c) for c in docs.columns} | {"text": text}
    return both.select(*(kept[c] for c in docs.columns if c != "n_entities"), F.coalesce(F.size(replaced), F.lit(0)).cast("bigint").alias("n_entities"))
