"""Formats by content: as a function, and as a column for what can be told without unpacking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.sources import chm, fb2, lit, lrf, mobi, zipbooks

#: In this order the first that matches wins.
READERS = (
    ("mobi", mobi.supports_mobi, mobi.read_mobi),
    ("ereader", mobi.supports_ereader, mobi.read_ereader),
    ("epub", zipbooks.supports_epub, zipbooks.read_epub),
    ("fb3", zipbooks.supports_fb3, zipbooks.read_fb3),
    ("fb2", fb2.supports, fb2.read),
    ("lit", lit.supports, lit.read),
    ("chm", chm.supports, chm.read),
    ("lrf", lrf.supports, lrf.read),
)


def detect(data: bytes) -> str | None:
    """Name of a file's format, None if no reader takes it."""
    return next((name for name, supports, _ in READERS if supports(data)), None)


def sniff(content: Column) -> Column:
    """Format by the first bytes; 'zip' for archives, which only unpacking tells apart; null for others."""
    ident = F.upper(F.decode(F.substring(content, 61, 8), "ISO-8859-1"))
    head = F.decode(F.substring(content, 1, 8), "ISO-8859-1")
    text = F.translate(F.decode(F.substring(content, 1, 32768), "ISO-8859-1"), "\0", "")
    return (
        F.when(ident.isin("BOOKMOBI", "TEXTREAD"), "mobi")
        .when(ident.isin("PNRDPPRS", "PNPDPPRS"), "ereader")
        .when(head.startswith("PK\x03\x04"), "zip")
        .when(text.rlike(r"<(?:[\w.-]+:)?FictionBook(?:[\s/>]|$)"), "fb2")
        .when(head == "ITOLITLS", "lit")
        .when(head.startswith("ITSF"), "chm")
        .when(head.startswith("L\0R\0F\0\0\0"), "lrf")
    )
