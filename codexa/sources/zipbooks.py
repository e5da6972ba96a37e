"""EPUB and FictionBook 3: ZIP files with an XML package."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote

from codexa.functions import charset
from codexa.functions.conversion import textual
from codexa.functions.strings import FB3_BODY
from codexa.sources import opf
from codexa.sources.containers import Zip, is_zip
from codexa.sources.model import Book, Corrupt, Options, OverLimit, Protected, Resource, clean_href, dedupe, resolve, split_identifier
from codexa.sources.opf import local, parse_xml, text_of

# Names, types and algorithms of the container formats.
EPUB_TYPE = b"application/epub+zip"
CONTAINER, ENCRYPTION, RIGHTS = "META-INF/container.xml", "META-INF/encryption.xml", "META-INF/rights.xml"
OPF_TYPE = "application/oebps-package+xml"
FONT_ALGORITHMS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
BOOK_RELATION = "http://www.fictionbook.org/FictionBook3/relationships/Book"
BODY_RELATION, COVER_RELATION = "http://www.fictionbook.org/FictionBook3/relationships/body", "http://schemas.openxmlformats.org/package/2006/relationships/metadata/thumbnail"
TYPES_PART, ROOT_RELS = "[Content_Types].xml", "_rels/.rels"
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp"}


def loader(z: Zip, options: Options):
    """Reads an entry into a Resource's fields; what is over the limit gets an error of its own."""

    def load(name: str, mime: str) -> dict:
        size = z.size(name)
        try:
            head = z.head(name, 8192) if textual(mime) else b""
            content = z.read(name) if options.with_content else None
        except OverLimit as e:
            return {"size": size, "error_code": e.code, "error_msg": str(e)}
        except Corrupt as e:
            return {"size": size, "error_code": e.code, "error_msg": str(e)}
        return {"size": size, "content": content, "charset": charset.declared(head) or ""}

    return load


def supports_epub(data: bytes) -> bool:
    if len(data) < 22 or not is_zip(data):
        return False
    if data[30:58] == b"mimetype" + EPUB_TYPE:
        return True
    try:
        z = Zip(data, 1 << 20)
        return ("mimetype" in z and z.head("mimetype", 64).strip() == EPUB_TYPE) or CONTAINER in z
    except Corrupt:
        return False


def _adobe(z: Zip) -> bool:
    if ENCRYPTION not in z:
        return False
    try:
        data = z.read(ENCRYPTION)
        if not data.strip():
            return False
        found = [v for e in parse_xml(data).iter() if local(e.tag) == "EncryptionMethod" for k, v in e.attrib.items() if local(k) == "Algorithm"]
    except (Corrupt, OverLimit):
        return True
    return any(a not in FONT_ALGORITHMS for a in found)


def _kobo(z: Zip, book: Book) -> bool:
    name = next((n for n in (RIGHTS, "rights.xml") if n in z), None)
    if name is None or not z.head(name, 1) or not book.order:
        return False
    first = book.order[0][0]
    head = z.head(first.resolved_href, 8192) if first.resolved_href in z else b""
    return not (b"<?xml" in head.lower() or b"<html" in head.lower() or b"koboSpan" in head)


def read_epub(data: bytes, options: Options) -> Book:
    z = Zip(data, options.max_resource)
    if _adobe(z):
        raise Protected("encrypted entries")
    if CONTAINER not in z:
        raise Corrupt("no container.xml")
    roots = [e.attrib for e in parse_xml(z.read(CONTAINER)).iter() if local(e.tag) == "rootfile"]
    path = next((a.get("full-path", "") for a in roots if a.get("media-type") == OPF_TYPE), "")
    if not path or path not in z:
        raise Corrupt("no package document")
    package = opf.read(z.read(path))
    book = Book(file_type="epub", version=package.version)
    opf.metadata(package, book)
    names = {clean_href(n): n for n in reversed(z.names)}
    opf.assemble(package, book, path, lambda p: names.get(p) or names.get(clean_href(unquote(p))), loader(z, options))
    if _kobo(z, book):
        raise Protected("rights.xml")
    return book


class Parts:
    """Parts of an open package: case-insensitive names, content types, relations."""

    def __init__(self, z: Zip) -> None:
        self.zip = z
        self.names = {n.lower().lstrip("/"): n for n in reversed(z.names)}
        self.overrides: dict[str, str] = {}
        self.defaults: dict[str, str] = {}
        if name := self.find(TYPES_PART):
            for e in parse_xml(z.read(name)).iter():
                if local(e.tag) == "Override":
                    self.overrides.setdefault(e.attrib.get("PartName", "").lower().lstrip("/"), e.attrib.get("ContentType", ""))
                elif local(e.tag) == "Default":
                    self.defaults.setdefault(e.attrib.get("Extension", "").lower(), e.attrib.get("ContentType", ""))

    def find(self, path: str) -> str | None:
        path = path.lstrip("/")
        return self.names.get(path.lower()) or self.names.get(unquote(path).lower())

    def media_type(self, name: str) -> str:
        extension = name.rpartition(".")[2].lower()
        return self.overrides.get(name.lower()) or self.defaults.get(extension) or IMAGE_TYPES.get(extension) or "application/octet-stream"

    def relations(self, part: str) -> list[tuple[str, str, str]]:
        """(id, type, target part) of a part; '' for the package."""
        folder, base = posixpath.split(part)
        name = self.find(posixpath.join(folder, "_rels", base + ".rels")) if part else self.find(ROOT_RELS)
        if name is None:
            return []
        found = [e.attrib for e in parse_xml(self.zip.read(name)).iter() if local(e.tag) == "Relationship"]
        return [(a.get("Id", ""), a.get("Type", ""), a["Target"].lstrip("/") if a.get("Target", "").startswith("/") else resolve(part or "x", a.get("Target", ""))) for a in found]


def supports_fb3(data: bytes) -> bool:
    if not is_zip(data):
        return False
    try:
        parts = Parts(Zip(data, 1 << 22))
        if any("fb3" in t.lower() or "fictionbook3" in t.lower() for t in [*parts.overrides.values(), *parts.defaults.values()]):
            return True
        if any(t == BOOK_RELATION for _, t, _ in parts.relations("")):
            return True
        return len(parts.zip.names) <= 5 and any(re.search(rb"<(?:[\w.-]+:)?fb3-(?:description|body)[\s/>]", parts.zip.head(n, 4096)) for n in parts.zip.names)
    except (Corrupt, OverLimit):
        return False


def _squash(s: str) -> str:
    return " ".join(s.split())


def read_fb3(data: bytes, options: Options) -> Book:
    z = Zip(data, options.max_resource)
    parts = Parts(z)
    root = parts.relations("")
    described = next((parts.find(t) for _, kind, t in root if kind == BOOK_RELATION), None) or next((n for n in z.names if n.lower().endswith("description.xml")), None)
    if described is None:
        raise Corrupt("no description part")
    book = Book(file_type="fb", version="3.0")
    info = parse_xml(z.read(described))
    child = lambda e, *path: child(next((x for x in e if local(x.tag) == path[0]), None), *path[1:]) if path and e is not None else e
    value = lambda e: _squash(text_of(e)) if e is not None else ""
    book.title = value(child(info, "title", "main"))
    for subject in child(info, "fb3-relations") if child(info, "fb3-relations") is not None else ():
        if local(subject.tag) == "subject" and subject.attrib.get("link", "") in ("author", "co_author"):
            names = [value(child(subject, n)) for n in ("first-name", "middle-name", "last-name")]
            if name := " ".join(n for n in names if n) or value(child(subject, "title", "main")):
                book.authors.append(name)
    groups = child(info, "fb3-classification")
    book.subjects = dedupe([value(e) for e in (groups if groups is not None else ()) if local(e.tag) == "subject" and value(e)])
    book.languages = [value(e) for e in info if local(e.tag) == "lang" and value(e)][:1]
    note = child(info, "annotation")
    if note is not None:
        book.description = "\n".join(x for e in note if (x := value(e))) or value(note)
    sequence = next((e for e in info if local(e.tag) == "sequence"), None)
    paper = child(info, "paper-publish-info")
    sequence = sequence if sequence is not None else child(paper, "sequence") if paper is not None else None
    if sequence is not None:
        book.series = value(child(sequence, "title", "main")) or (value(sequence) if not len(sequence) else "")
        book.series_index = sequence.attrib.get("number", "")
    if paper is not None:
        book.publisher, book.publication_date = paper.attrib.get("publisher", ""), paper.attrib.get("year", "")
    if info.attrib.get("id"):
        book.identifiers.append(("UUID", split_identifier(info.attrib["id"], "UUID")[1]))
    document = child(info, "document-info")
    for scheme, found in (
        ("ISBN", [document, "isbn"]), ("DOI", [document, "doi"]), ("ISBN", [paper, "isbn"]), ("ISSN", [paper, "issn"]), ("URL", [document, "src-url"]),
    ):
        if found[0] is not None:
            book.identifiers += [(scheme, value(e)) for e in found[0].iter() if local(e.tag) == found[1] and value(e)]
            if found[0].attrib.get(found[1]):
                book.identifiers.append((scheme, found[0].attrib[found[1]]))
    load = loader(z, options)
    relations = parts.relations(described)
    body = next((parts.find(t) for _, kind, t in relations if kind == BODY_RELATION), None) or next((n for n in z.names if n.lower().endswith("body.xml")), None)
    if body is None:
        raise Corrupt("no body part")
    main = Resource(id="body", name=posixpath.basename(body), media_type=FB3_BODY, href=body, resolved_href=body, **load(body, FB3_BODY))
    book.resources.append(main)
    book.order.append((main, True))
    for i, _, target in parts.relations(body):
        name = parts.find(target)
        mime = parts.media_type(name) if name else ""
        if name and mime.startswith("image/"):
            book.resources.append(Resource(id=i, name=posixpath.basename(name), media_type=mime, href=name, resolved_href=name, **load(name, mime)))
    thumb = next((parts.find(t) for _, kind, t in root if kind == COVER_RELATION), None)
    if thumb:
        mime = parts.media_type(thumb)
        book.cover = Resource(id="cover", name=posixpath.basename(thumb), media_type=mime, href=thumb, resolved_href=thumb, **load(thumb, mime))
    return book
