"""What a reader makes of a file: a book with resources and a reading order, and the tables' schemas."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from codexa.functions import charset
from codexa.functions.conversion import textual

MAX_RESOURCE = MAX_RECORD = 100_000_000
MAX_EXTH = 256

BOOK = (
    "path string, file_type string, version string, sha256 string, title string, authors array<string>, description string, subjects array<string>, languages array<string>, "
    "identifiers array<struct<scheme:string,value:string>>, publisher string, publication_date string, series string, series_index string, cover_pos int, error_code string, error_msg string"
)
RESOURCE = "pos int, id string, name string, media_type string, href string, resolved_href string, properties string, charset string, size long, content binary, error_code string, error_msg string"
ORDER = "pos int, resource_pos int, linear boolean"


class BookError(Exception):
    """A file that cannot be read; code names the kind."""

    code = "CORRUPT"


class Unsupported(BookError):
    code = "UNSUPPORTED_FORMAT"


class Protected(BookError):
    code = "DRM"


class OverLimit(BookError):
    code = "LIMIT_EXCEEDED"


class Corrupt(BookError):
    code = "CORRUPT"


@dataclass(frozen=True)
class Options:
    """Limits of a reader; numbers that are not positive stand for the defaults."""

    max_resource: int = MAX_RESOURCE
    max_record: int = MAX_RECORD
    max_exth: int = MAX_EXTH
    mobi6_fallback: bool = True
    with_content: bool = True

    def resolved(self) -> Options:
        pick = lambda n, d: n if n > 0 else d
        return Options(pick(self.max_resource, MAX_RESOURCE), pick(self.max_record, MAX_RECORD), pick(self.max_exth, MAX_EXTH), self.mobi6_fallback, self.with_content)


@dataclass
class Resource:
    id: str = ""
    name: str = ""
    media_type: str = ""
    href: str = ""
    resolved_href: str = ""
    properties: str = ""
    charset: str = ""
    size: int = 0
    content: bytes | None = None
    error_code: str | None = None
    error_msg: str | None = None

    def __post_init__(self) -> None:
        given = charset.normalize(self.charset)
        self.charset = given or (charset.UTF8 if textual(self.media_type) else charset.BINARY)


@dataclass
class Book:
    file_type: str = ""
    version: str = ""
    title: str = ""
    authors: list[str] = field(default_factory=list)
    description: str = ""
    subjects: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    identifiers: list[tuple[str, str]] = field(default_factory=list)
    publisher: str = ""
    publication_date: str = ""
    series: str = ""
    series_index: str = ""
    resources: list[Resource] = field(default_factory=list)
    order: list[tuple[Resource, bool]] = field(default_factory=list)
    cover: Resource | None = None


def clean_href(href: str) -> str:
    """The key of an href: without fragment and query, lexically shortest."""
    for mark in "#?":
        href = href.partition(mark)[0]
    path = posixpath.normpath(href) if href else "."
    return "/" + path.lstrip("/") if path.startswith("/") else path


def resolve(base: str, href: str) -> str:
    return clean_href(posixpath.join(posixpath.dirname(base), href))


def canonical(book: Book) -> None:
    """One resource for each href, the first; equal ids of different hrefs renamed; order and cover point to what is kept."""
    by_href: dict[str, Resource] = {}
    ids: set[str] = set()
    kept: list[Resource] = []

    def free(name: str) -> str:
        n = 1
        while f"{name}__dup{n}" in ids:
            n += 1
        return f"{name}__dup{n}"

    for r in book.resources:
        key = clean_href(r.resolved_href) if r.resolved_href else ""
        if key and key in by_href:
            if r.id:
                ids.add(r.id)  # from now on another name of the kept one
            continue
        if r.id in ids and r.id:
            r.id = free(r.id)
        if key:
            by_href[key] = r
        if r.id:
            ids.add(r.id)
        kept.append(r)
    stand_in = lambda r: by_href.get(clean_href(r.resolved_href), r) if r.resolved_href else r
    book.resources = kept
    book.order = [(stand_in(r), linear) for r, linear in book.order]
    if book.cover is not None:
        book.cover = stand_in(book.cover)
    for r in [*(r for r, _ in book.order), *([book.cover] if book.cover else [])]:
        if not any(r is k for k in kept):
            kept.append(r)


def split_subjects(values: list[str]) -> list[str]:
    return [s for v in values for x in v.split(";") if (s := x.strip())]


def dedupe(values: list[str]) -> list[str]:
    first: dict[str, str] = {}
    for v in values:
        first.setdefault(v.lower(), v)
    return list(first.values())


_KNOWN = {"DOI": "DOI", "UUID": "UUID", "ASIN": "ASIN", "ISSN": "ISSN", "URL": "URL", "URI": "URL"}


def canonical_scheme(scheme: str) -> str:
    s = scheme.strip()
    return "ISBN" if s.upper().startswith("ISBN") else _KNOWN.get(s.upper(), s)


def split_identifier(value: str, explicit: str = "") -> tuple[str, str]:
    """Scheme and value of an identifier; see functions.strings.identifier for the rule."""
    value, own = value.strip(), canonical_scheme(explicit)
    if not value:
        return "", ""
    name = "[A-Za-z][A-Za-z0-9+.-]*"
    url = re.match(f"{name}://", value) or ("://" not in value and re.match("(?i)(https?|ftp):", value))
    urn = value[:4].lower() == "urn:"
    m = re.match(f"({name}):(.*)", value[4:] if urn else value, re.S)
    if own:
        return own, m[2].strip() if m and not url and canonical_scheme(m[1]).lower() == own.lower() else value
    if url:
        return "URL", value
    return (canonical_scheme(m[1]), m[2].strip()) if m else ("", value)


def image_type(data: bytes) -> tuple[str, str]:
    """Media type and extension by an image's first bytes."""
    if data.startswith(b"\xff\xd8\xff"):
        return "image/jpeg", "jpg"
    if data.startswith(b"\x89PNG") and len(data) >= 8:
        return "image/png", "png"
    if data.startswith(b"GIF"):
        return "image/gif", "gif"
    head = data[:1024].lstrip()
    if head.startswith(b"<svg") or b"<?xml" in head:
        return "image/svg+xml", "svg"
    return "application/octet-stream", "bin"
