"""FictionBook 2, plain or in a ZIP file."""

from __future__ import annotations

import base64
import binascii
import re
import xml.etree.ElementTree as ET

from codexa.functions import charset
from codexa.functions.strings import FB2_BODY
from codexa.sources.containers import Zip, is_zip
from codexa.sources.model import Book, Corrupt, Options, OverLimit, Resource, Unsupported, dedupe, image_type, split_identifier
from codexa.sources.opf import local, parse_xml, text_of

HEAD = 32 * 1024
_ROOT = re.compile(rb"<(?:[\w.-]+:)?FictionBook(?:[\s/>]|$)")
# Comments and CDATA come first, so that tags within them are passed over.
_BODY = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/)?(?:[\w.-]+:)?body(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)


def _sniff(data: bytes) -> bool:
    return _ROOT.search(data[:HEAD].replace(b"\0", b"")) is not None


def _inner(data: bytes, options: Options) -> bytes | None:
    """The book in a ZIP file: the first .fb2 entry decides, else one of the first five."""
    z = Zip(data, options.max_resource)
    named = [n for n in z.names if n.lower().endswith(".fb2")]
    for name in named[:1] or z.names[:5]:
        if _sniff(z.head(name, HEAD)):
            return z.read(name)
    return None


def supports(data: bytes) -> bool:
    if not is_zip(data):
        return _sniff(data)
    try:
        return _inner(data, Options()) is not None
    except (Corrupt, OverLimit):
        return False


def label(data: bytes) -> str:
    if data[:4] == b"\xff\xfe\0\0" or data[:4] == b"\0\0\xfe\xff":
        raise Unsupported("utf-32")
    return charset.declared(data) or charset.UTF8


def sanitized(name: str) -> str:
    return re.sub(r"[^\w\-.]", "_", name) or "image"


class _Find:
    """Children of an element by path, prefixes ignored."""

    def __init__(self, e: ET.Element | None) -> None:
        self.e = e

    def all(self, *path: str) -> list[ET.Element]:
        found = [self.e] if self.e is not None else []
        for name in path:
            found = [c for e in found for c in e if local(c.tag) == name]
        return found

    def text(self, *path: str) -> str:
        return next((t for e in self.all(*path) if (t := " ".join(text_of(e).split()))), "")


def _name(e: ET.Element) -> str:
    f = _Find(e)
    return " ".join(p for n in ("first-name", "middle-name", "last-name") if (p := f.text(n))) or f.text("nickname") or " ".join((e.text or "").split())


def _annotation(e: ET.Element) -> str:
    """Lines of an annotation; an empty line stays as one."""
    out = []
    for child in e:
        if local(child.tag) == "empty-line":
            out.append("")
        elif line := " ".join(text_of(child).split()):
            out.append(line)
    return "\n".join(out).strip() or " ".join(text_of(e).split())


def _metadata(root: ET.Element, book: Book) -> str:
    """Fills the book and gives the id of the cover's picture."""
    d = (_Find(root).all("description") or [None])[0]
    part = lambda n: _Find((_Find(d).all(n) or [None])[0])
    title, source, document, publish = part("title-info"), part("src-title-info"), part("document-info"), part("publish-info")
    book.title = title.text("book-title") or source.text("book-title")
    for section in (title, source, document):
        book.authors = [n for e in section.all("author") if (n := _name(e))]
        if book.authors:
            break
    book.description = next((t for s in (title, source) for e in s.all("annotation") if (t := _annotation(e))), "")
    for section in (title, source):
        values = [text_of(e) for e in section.all("genre")] + [k for e in section.all("keywords") for k in text_of(e).split(",")]
        book.subjects = dedupe([s for v in values for x in v.split(";") if (s := x.strip())])
        if book.subjects:
            break
    book.languages = [t for e in title.all("lang") if (t := text_of(e).strip())]
    book.publisher = publish.text("publisher")
    book.publication_date = publish.text("year") or next((e.attrib.get("value", "") or text_of(e).strip() for e in title.all("date")), "")
    for section in (title, publish):
        if found := section.all("sequence"):
            book.series, book.series_index = found[0].attrib.get("name", ""), found[0].attrib.get("number", "")
            break
    for section, name, scheme in ((document, "id", ""), (publish, "isbn", "ISBN"), (document, "src-url", "URL")):
        for e in section.all(name):
            pair = split_identifier(text_of(e), scheme)
            if pair[1]:
                book.identifiers.append(pair)
    for section in (title, source):
        for e in section.all("coverpage", "image"):
            if href := next((v for k, v in e.attrib.items() if local(k) == "href"), ""):
                return href.lstrip("#")
    return ""


def bodies(text: str) -> list[str]:
    """Each outer <body> with its tags; one that never ends runs to the end."""
    out, depth, start = [], 0, 0
    for m in _BODY.finditer(text):
        if not m[0].startswith(("<!--", "<![")):
            if m["end"]:
                depth -= depth > 0
                if not depth and start >= 0:
                    out.append(text[start : m.end()])
                    start = -1
            elif not m[0].endswith("/>"):
                if not depth:
                    start = m.start()
                depth += 1
    if depth and start >= 0:
        out.append(text[start:])
    return out


def read(data: bytes, options: Options) -> Book:
    raw = _inner(data, options) if is_zip(data) else data
    if raw is None:
        raise Unsupported("no FictionBook in the archive")
    encoding = label(raw)
    text = charset.decode(raw, encoding).replace("\0", "").lstrip("﻿")
    text = re.sub(r"^\s*<\?xml.*?\?>", "", text, count=1, flags=re.S)  # its encoding no longer holds
    try:
        root = parse_xml(text.encode())
    except Corrupt:
        head = text.partition("<body")[0]
        root = parse_xml((head + f"</{(re.search(r'<((?:[\w.-]+:)?FictionBook)', head) or ['', 'FictionBook'])[1]}>").encode())
    space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else ""
    book = Book(file_type="fb", version=next((v for v in ("2.0", "2.1") if space.endswith(v)), ""))
    cover = _metadata(root, book)
    for i, body in enumerate(bodies(text)):
        name = f"body{i}.xml" if i else "body.xml"
        content = body.encode()
        r = Resource(id=name.partition(".")[0], name=name, media_type=FB2_BODY, href=name, resolved_href=name, size=len(content))
        if len(content) > options.max_resource:
            r.error_code, r.error_msg = OverLimit.code, f"{name} is over {options.max_resource} bytes"
        elif options.with_content:
            r.content = content
        book.resources.append(r)
        book.order.append((r, i == 0))
    taken: set[str] = set()
    for e in root:
        if local(e.tag) != "binary":
            continue
        mime = e.attrib.get("content-type", "").strip().lower()
        try:
            content = base64.b64decode(re.sub(r"[^A-Za-z0-9+/]", "", e.text or "") + "==", validate=False)
        except (binascii.Error, ValueError):
            continue
        if (mime and not mime.startswith("image/")) or not content:
            continue
        found, extension = image_type(content)
        name = sanitized(e.attrib.get("id", ""))
        stem, _, tail = name.rpartition(".") if "." in name else (name, "", extension)
        n, unique = 1, name
        while unique in taken:
            n += 1
            unique = f"{stem}-{n}.{tail}"
        taken.add(unique)
        r = Resource(id=e.attrib.get("id", ""), name=unique, media_type=mime or found, href=unique, resolved_href=unique, size=len(content), content=content if options.with_content else None)
        if cover and r.id == cover and book.cover is None:
            r.properties, book.cover = "cover-image", r
        book.resources.append(r)
    return book
