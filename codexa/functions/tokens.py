"""Words and shingles of a text, as fingerprints take them.

words() is the full rule on Python strings, run over Arrow batches. native_words()
is a column expression for text without line-end hyphens, format characters and
characters that compatibility folding changes; on such text both agree but for
letters other than ß whose case folding is longer than their lower case.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions.strings import bind

#: Longest gap between a line-end hyphen and the rest of the word, in characters.
GAP = 1024

_FORMAT = regex.compile(r"\p{Cf}+")
_BREAK = regex.compile(r"[\p{P}\p{S}\p{Z}\p{Cc}]+")
_TAIL = regex.compile(r"[^\p{P}\p{S}\p{Z}\p{Cc}]*\Z", regex.REVERSE)
_BLANK = "[ \t\v\f\x85\xa0  -     　]"
_HYPHEN = regex.compile(rf"-{_BLANK}*(?:\r\n|\r|\n){_BLANK}*(?=\p{{L}})(?!\p{{Lu}}|\p{{Lt}})")
_LETTER = regex.compile(r"\p{L}")


def _joined(text: str) -> str:
    """Words that a hyphen at the end of a line cuts, in one piece."""
    out, at = "", 0
    for m in _HYPHEN.finditer(text):
        piece = out + text[at : m.start()]
        run = _TAIL.search(piece)[0]
        gap = m.end() - m.start() - 1 - ("\r\n" in m[0])
        ends = run and unicodedata.category(run[-1])[0] in "LM"
        if ends and gap <= GAP and len(_LETTER.findall(run)) >= 2:
            out, at = piece, m.end()
    return out + text[at:]


@functools.lru_cache(maxsize=1 << 16)
def _folded(word: str) -> str:
    """A word compatibility-folded and case-folded; frequent words are folded once."""
    return unicodedata.normalize("NFKC", word).casefold()


def words(text: str | None) -> list[str]:
    """Words of a text: format characters dropped, split at punctuation, symbols, space and controls, line-end
    hyphens joined, each word compatibility-folded and case-folded."""
    if not text:
        return []
    if text.isascii():
        plain = _joined(text) if "-" in text else text
        return [w.lower() for w in _BREAK.split(plain) if w]
    plain = _FORMAT.sub("", text)
    if "-" in plain:
        plain = _joined(plain)
    return [_folded(w) for w in _BREAK.split(plain) if w]


def shingles(found: list[str], k: int) -> list[str]:
    """Runs of k words joined by a space; fewer words give one of all, none give none."""
    if not found:
        return []
    return [" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))]


def native_words(text: Column) -> Column:
    """Words of plain text as a column expression."""
    plain = F.replace(F.lower(F.regexp_replace(text, r"\p{Cf}+", "")), F.lit("ß"), F.lit("ss"))
    return F.filter(F.split(plain, r"[\p{P}\p{S}\s\p{Z}\p{Cc}]+"), lambda w: w != "")


def native_shingles(found: Column, k: int) -> Column:
    """shingles() as a column expression over an array of words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        return F.when(n > 0, F.transform(at, lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.expr("cast(array() as array<string>)"))

    return bind(found, of)


def tokenize(text: Column) -> Column:
    """words() of each text; null gives an empty array."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    return F.pandas_udf(run, "array<string>")(text)
