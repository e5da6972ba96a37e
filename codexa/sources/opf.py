"""OPF packages: metadata, manifest and spine, shared by EPUB, LIT and PalmDOC books."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from codexa.functions import charset
from codexa.sources.model import Book, Corrupt, Resource, resolve, split_identifier, split_subjects

# Codes of identifier types in a publishers' code list.
ONIX = {"02": "ISBN", "15": "ISBN", "24": "ISBN", "06": "DOI"}


def local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def parse_xml(data: bytes) -> ET.Element:
    """The root of a document; a stray ampersand before a space is forgiven."""
    text = charset.decode(data).lstrip("﻿").lstrip()
    text = re.sub(r"^<\?xml.*?\?>", "", text, count=1, flags=re.S)
    text = re.sub(r"&(?!#|amp;|lt;|gt;|quot;|apos;)([A-Za-z][A-Za-z0-9]*);", _entity, text)
    try:
        return ET.fromstring(text)
    except ET.ParseError as e:
        try:
            return ET.fromstring(text.replace("& ", "&amp; "))
        except ET.ParseError:
            raise Corrupt(f"xml: {e}") from e


def _entity(m: re.Match) -> str:
    return html.entities.html5.get(m[1] + ";", "&amp;" + m[1] + ";")


def text_of(e: ET.Element) -> str:
    return "".join(e.itertext())


def _attr(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if local(k) == name), "")


@dataclass
class Package:
    version: str = ""
    direct: dict[str, list[ET.Element]] = field(default_factory=dict)
    wrapped: dict[str, list[ET.Element]] = field(default_factory=dict)
    metas: list[dict] = field(default_factory=list)
    items: list[dict[str, str]] = field(default_factory=list)
    itemrefs: list[dict[str, str]] = field(default_factory=list)

    def both(self, name: str) -> list[ET.Element]:
        return self.direct.get(name, []) + self.wrapped.get(name, [])


def read(data: bytes) -> Package:
    root = parse_xml(data)
    out = Package(version=_attr(root, "version"))
    for part in root.iter():
        name = local(part.tag)
        if name == "metadata":
            for e in part:
                if local(e.tag) in ("dc-metadata", "x-metadata"):
                    for inner in e:
                        _add(out, out.wrapped, inner)
                else:
                    _add(out, out.direct, e)
        elif name == "manifest":
            out.items += [{local(k): v for k, v in e.attrib.items()} for e in part if local(e.tag) == "item"]
        elif name == "spine":
            out.itemrefs += [{local(k): v for k, v in e.attrib.items()} for e in part if local(e.tag) == "itemref"]
    return out


def _add(out: Package, into: dict[str, list[ET.Element]], e: ET.Element) -> None:
    if local(e.tag) == "meta":
        out.metas.append({**{local(k): v for k, v in e.attrib.items()}, "text": text_of(e).strip()})
    else:
        into.setdefault(local(e.tag).lower() if into is out.wrapped or local(e.tag)[:1].islower() else local(e.tag), []).append(e)


def metadata(p: Package, book: Book) -> None:
    """Fill a book's fields by the rules of a package."""
    first = lambda name: next((t for e in p.both(name) if (t := text_of(e).strip())), "")
    titles = p.direct.get("title") or p.wrapped.get("title") or []
    book.title = text_of(titles[0]).strip() if titles else ""
    for group in (p.direct, p.wrapped):
        people = [e for e in group.get("creator", []) if _attr(e, "role").lower() in ("", "aut")]
        book.authors = [n for e in people if (n := text_of(e).strip() or _attr(e, "file-as").strip())]
        if book.authors:
            break
    book.description, book.publisher = first("description"), first("publisher")
    book.subjects = split_subjects([text_of(e) for e in p.both("subject")])
    for group in (p.direct.get("language"), p.wrapped.get("language"), p.direct.get("Language")):
        book.languages = [t for e in group or [] if (t := text_of(e).strip())]
        if book.languages:
            break
    dates = [(_attr(e, "event").lower(), t) for e in p.both("date") if (t := text_of(e).strip())]
    book.publication_date = next((t for event, t in dates if event == "publication"), next((t for event, t in dates if not event), ""))
    refined = lambda i, prop: next((m["text"] for m in p.metas if m.get("refines") == f"#{i}" and m.get("property") == prop), "")
    for m in p.metas:
        if m.get("property") == "belongs-to-collection" and m.get("id") and refined(m["id"], "collection-type") == "series":
            book.series, book.series_index = m["text"], refined(m["id"], "group-position")
            break
    else:
        named = {m["name"]: m.get("content", "") for m in reversed(p.metas) if m.get("name")}
        if named.get("calibre:series"):
            book.series, book.series_index = named["calibre:series"].strip(), named.get("calibre:series_index", "").strip()
    for name in ("identifier", "source"):
        for e in p.both(name):
            scheme = _attr(e, "scheme")
            if not scheme and (i := _attr(e, "id")):
                code = refined(i, "identifier-type")
                scheme = ONIX.get(code, "" if code.isdigit() else code)
            pair = split_identifier(text_of(e), scheme)
            if pair[1]:
                book.identifiers.append(pair)


def assemble(p: Package, book: Book, base: str, lookup, load) -> None:
    """Manifest and spine. lookup(path) gives the stored name or None, load(name) its Resource fields."""
    by_id: dict[str, Resource] = {}
    by_item: dict[str, dict[str, str]] = {}
    for item in p.items:
        path = resolve(base, item.get("href", ""))
        by_item.setdefault(item.get("id", ""), item)
        stored = lookup(path)
        if stored is None:
            continue
        r = Resource(id=item.get("id", ""), name=path.rpartition("/")[2], media_type=item.get("media-type", ""), href=item.get("href", ""), resolved_href=path, properties=item.get("properties", ""), **load(stored, item.get("media-type", "")))
        book.resources.append(r)
        by_id.setdefault(r.id, r)
    for ref in p.itemrefs:
        if r := by_id.get(ref.get("idref", "")):
            book.order.append((r, ref.get("linear", "") != "no"))
    marked = next((i.get("id", "") for i in p.items if "cover-image" in i.get("properties", "")), "")
    named = marked or next((m.get("content", "") for m in p.metas if m.get("name") == "cover"), "")
    book.cover = by_id.get(named)
