"""ISBN: normalising, checking, converting, placeholders as column expressions; search as a Python function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions.strings import bind

# Nine-digit cores of test data and examples.
TEST_CORES = ("123456789", "987654321", "012345678", "214748364", "429496729", "314159265", "271828182", "161803398", "123123123", "111222333", "101010101")
# Kinds of placeholders.
PLACEHOLDERS = ("none", "all_same", "sequential", "repeated", "low_entropy", "known_test")

# Separators: hyphens and white space; written for Java and for Python.
_DASH = "\\-\u2010-\u2014\u2212"
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATOR = f"[{_DASH}{_SPACE}]"
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def _weighted(c: Column, weights: list[int]) -> Column:
    """Sum of the digits (X counts 10) times their weights; null if there are not as many."""
    digits = F.zip_with(F.split(c, ""), F.lit(weights), lambda d, w: F.when(d == "X", 10).otherwise(d.try_cast("int")) * w)
    return F.aggregate(digits, F.lit(0), lambda s, x: s + x)


def check_digit_10(body: Column) -> Column:
    """Check character of nine digits."""
    n = (11 - _weighted(body, list(range(10, 1, -1))) % 11) % 11
    return bind(n, lambda n: F.when(n == 10, "X").otherwise(n.cast("string")))


def check_digit_13(body: Column) -> Column:
    """Check digit of twelve digits."""
    return ((10 - _weighted(body, [1, 3] * 6) % 10) % 10).cast("string")


def normalize(c: Column) -> Column:
    """Canonical digits of one ISBN written in a common way, null if it is none.

    Digits of Arabic and Persian script count; text that needs compatibility folding first (full-width
    digits and the like) is for normalize_exact.
    """
    s = F.translate(c, *DIGITS)
    s = F.regexp_replace(s, f"^[{_SPACE}]*(?i:urn:isbn:)?[{_SPACE}]*", "")
    body = F.regexp_replace(s, f"^(?i:isbn){SEPARATOR}*(?:(?:10|13)(?=$|:|{SEPARATOR}){SEPARATOR}*)?:?{SEPARATOR}*", "")
    plain = F.upper(F.regexp_replace(body, f"{SEPARATOR}+", ""))

    def checked(x: Column) -> Column:
        ten = x.rlike(r"^[0-9]{9}[0-9X]$") & (_weighted(x, list(range(10, 0, -1))) % 11 == 0)
        thirteen = x.rlike(r"^97[89][0-9]{10}$") & (_weighted(x, [1, 3] * 6 + [1]) % 10 == 0)
        return F.when(ten | thirteen, x)

    return bind(plain, checked)


def kind(isbn: Column) -> Column:
    """10, 13, or 0 for anything else."""
    return F.when(F.length(isbn).isin(10, 13), F.length(isbn)).otherwise(0)


def to13(isbn: Column) -> Column:
    """The ISBN-13 of canonical digits, null if they are none."""

    def longer(x: Column) -> Column:
        body = F.concat(F.lit("978"), F.substring(x, 1, 9))
        return F.when(F.length(x) == 13, x).when(F.length(x) == 10, F.concat(body, check_digit_13(body)))

    return bind(isbn, longer)


def to10(isbn: Column) -> Column:
    """The ISBN-10 of canonical digits; null for 979 and for no ISBN."""

    def shorter(x: Column) -> Column:
        body = F.substring(x, 4, 9)
        return F.when(F.length(x) == 10, x).when((F.length(x) == 13) & x.startswith("978"), F.concat(body, check_digit_10(body)))

    return bind(isbn, shorter)


def placeholder(isbn: Column) -> Column:
    """Code of the placeholder kind of canonical digits, by its place in PLACEHOLDERS; 0 for none."""
    core = bind(isbn, lambda x: F.when(F.length(x) == 10, F.substring(x, 1, 9)).when(F.length(x) == 13, F.substring(x, 4, 9)))
    return bind(core, _placeholder)


def _placeholder(core: Column) -> Column:
    ups, downs = "01234567890123456789", "98765432109876543210"
    distinct = F.size(F.array_distinct(F.split(core, "")))
    return (
        F.when(core.isNull(), 0)
        .when(core.rlike(r"^(\d)\1{8}$"), 1)
        .when(core.isin(*TEST_CORES), 5)
        .when(F.lit(ups).contains(core) | F.lit(downs).contains(core), 2)
        .when(core.rlike(r"^(\d)(\d)(?:\1\2){3}\1$") | core.rlike(r"^(\d{3})\1\1$") | core.rlike(r"^(\d)\1\1(\d)\2\2(\d)\3\3$") | core.rlike(r"(\d)\1{5}"), 3)
        .when(distinct <= 2, 4)
        .otherwise(0)
    )


def validate(c: Column) -> Column:
    """Canonical digits of a book's ISBN: normalised and no placeholder, else null."""
    return bind(normalize(c), lambda n: F.when(placeholder(n) == 0, n))


def is_valid(c: Column) -> Column:
    return validate(c).isNotNull()


# The same on Python strings, for texts that need compatibility folding and for search.

_TRIM = re.compile(f"^[{_SPACE}]*(?:urn:isbn:)?[{_SPACE}]*", re.I)
_LABEL = re.compile(f"^isbn{SEPARATOR}*(?:(?:10|13)(?=$|:|{SEPARATOR}){SEPARATOR}*)?:?{SEPARATOR}*", re.I)
_TABLE = str.maketrans(*DIGITS)


def folded(text: str) -> str:
    """Compatibility-folded, with digits of Arabic and Persian script as ASCII ones."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).translate(_TABLE)


def normalized(text: str) -> str | None:
    plain = re.sub(SEPARATOR, "", _LABEL.sub("", _TRIM.sub("", folded(text), count=1), count=1))
    plain = plain.replace("x", "X")
    if re.fullmatch("[0-9]{9}[0-9X]", plain):
        return plain if sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(plain)) % 11 == 0 else None
    if re.fullmatch("97[89][0-9]{10}", plain):
        return plain if sum((1, 3)[i % 2] * int(c) for i, c in enumerate(plain)) % 10 == 0 else None
    return None


def as13(isbn: str) -> str:
    if len(isbn) == 13:
        return isbn
    body = "978" + isbn[:9]
    return body + str(-sum((1, 3)[i % 2] * int(c) for i, c in enumerate(body)) % 10)


def placeholder_of(isbn: str) -> int:
    core = isbn[:9] if len(isbn) == 10 else isbn[3:12]
    if len(set(core)) == 1:
        return 1
    if core in TEST_CORES:
        return 5
    if core in "01234567890123456789" or core in "98765432109876543210":
        return 2
    periodic = any(all(core[i] == core[i - p] for i in range(p, 9)) for p in (2, 3))
    if periodic or re.search(r"(\d)\1{5}", core) or all(len(set(core[i : i + 3])) == 1 for i in (0, 3, 6)):
        return 3
    return 4 if len(set(core)) <= 2 else 0


def validated(text: str) -> str | None:
    found = normalized(text)
    return found if found and placeholder_of(found) == 0 else None


# What an ISBN looks like in running text, with the misreadings of optical recognition in the marker.
_S = "[\\t\\n\\f\\r ]"
_PD = "\\-\u058a\u05be\u1400\u1806\u2010-\u2015\u2e17\u2e1a\u2e3a\u2e3b\u2e40\u2e5d\u301c\u3030\u30a0\ufe31\ufe32\ufe58\ufe63\uff0d\U00010ead"
_GAP = f"[\\t\\n\\f\\r {_PD}]*"
_MARK = f"[1Il]{_S}*[S5]{_S}*[8B]{_S}*N(?:{_S}*[{_PD}]?{_S}*(?:10|13))?{_S}*[:：]?{_S}*"
_13, _10 = f"(97[89](?:{_GAP}[0-9]){{10}})", f"((?:[0-9]{_GAP}){{9}}[0-9Xx])"
PASSES = [(re.compile(_MARK + _13, re.I), True), (re.compile(_MARK + _10, re.I), True), (re.compile(_13), False), (re.compile(_10), False)]
_HINT = re.compile("[0-9]")


def find(text: str | None) -> list[str]:
    """ISBNs of books in a text by place, each book once, in the form found."""
    if not text:
        return []
    text = folded(text)
    if not _HINT.search(text):
        return []
    hits = []
    for pattern, marked in PASSES:
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if (not marked and a and _decimal(text[a - 1])) or (b < len(text) and _decimal(text[b])):
                continue
            if isbn := validated(m[1]):
                hits.append((a, isbn))
    hits.sort(key=lambda h: h[0])
    first: dict[str, str] = {}
    for _, isbn in hits:
        first.setdefault(as13(isbn), isbn)
    return list(first.values())


def _decimal(c: str) -> bool:
    return unicodedata.category(c) == "Nd"


def find_isbns(text: Column) -> Column:
    """Array of the ISBNs in each text."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(find)

    return F.pandas_udf(run, "array<string>")(text)


def normalize_exact(text: Column) -> Column:
    """normalize() for any text."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalized(t))

    return F.pandas_udf(run, "string")(text)


# Labels in front of a declared ISBN; the first that fits goes.
LABELLED = ("urn:isbn:", "isbn-13:", "isbn-10:", "isbn13:", "isbn10:", "isbn-13", "isbn-10", "isbn13", "isbn10", "isbn:", "isbn")


def declared_isbn(text: str) -> str | None:
    """A valid ISBN as it is written, without its label; None if it is none."""
    if validated(text) is None:
        return None
    value = text.strip()
    label = next((x for x in LABELLED if value.lower().startswith(x)), "")
    return value[len(label) :].strip().removeprefix(":").strip() if label else value


def of_digits(c: Column) -> Column:
    """The ISBN that the digits of a text (and X) make, null if they make none."""
    return validate(F.upper(F.regexp_replace(c, "[^0-9xX]", "")))


def declared(c: Column) -> Column:
    """declared_isbn() as a column."""
    bare = F.regexp_replace(F.trim(c), f"^(?i:{'|'.join(LABELLED)})", "")
    return F.when(validate(c).isNotNull(), F.when(bare == F.trim(c), bare).otherwise(F.trim(F.regexp_replace(F.trim(bare), "^:", ""))))
