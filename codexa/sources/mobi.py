"""Palm family: PalmDOC, MOBI 6, KF8 and files that hold both, eReader."""

from __future__ import annotations

import re
import struct

from codexa.functions.strings import HTML_TYPES, PLAIN, PML
from codexa.sources import opf
from codexa.sources.containers import Huff, PalmDatabase, inflate, palmdoc
from codexa.sources.locales import palm_language
from codexa.sources.model import Book, BookError, Corrupt, Options, OverLimit, Protected, Resource, image_type, split_identifier, split_subjects

NONE = 0xFFFFFFFF
MOBI_HTML = HTML_TYPES[2]
# Record types of extended headers.
AUTHOR, PUBLISHER, DESCRIPTION, ISBN, SUBJECT, DATE, SOURCE, ASIN, KF8_AT, COVER, TITLE, ASIN_2, LANGUAGE = 100, 101, 103, 104, 105, 106, 112, 113, 121, 201, 503, 504, 524


def supports_mobi(data: bytes) -> bool:
    return data[60:68].upper() in (b"BOOKMOBI", b"TEXTREAD")


def supports_ereader(data: bytes) -> bool:
    return data[60:68].upper() in (b"PNRDPPRS", b"PNPDPPRS")


class Header:
    """Record 0 of a MOBI book, or of its KF8 half."""

    def __init__(self, raw: bytes, options: Options) -> None:
        if len(raw) < 96:
            raise Corrupt("mobi: record 0 is too short")
        self.compression, _, self.text_size, self.text_records, _, self.encryption = struct.unpack_from(">HHIHHH", raw)
        self.size, _, encoding = struct.unpack_from(">III", raw, 20)
        self.codec = "utf-8" if encoding == 65001 else "windows-1252"
        (self.version,) = struct.unpack_from(">I", raw, 36)
        name_at, name_size, self.locale = struct.unpack_from(">III", raw, 84)
        self.first_image = self.huff = self.huff_count = self.flags = 0
        self.drm, self.extra = NONE, 0
        if len(raw) >= 184:
            self.first_image, self.huff, self.huff_count = struct.unpack_from(">III", raw, 108)
            (self.flags,) = struct.unpack_from(">I", raw, 128)
            (self.drm,) = struct.unpack_from(">I", raw, 168)
        if len(raw) >= 244 and raw[16:20] == b"MOBI" and 0xE4 <= self.size <= 500:
            (self.extra,) = struct.unpack_from(">H", raw, 242)
        self.fdst = self.div = self.skel = NONE
        if self.version == 8 and len(raw) >= 264:
            self.div, self.skel = struct.unpack_from(">II", raw, 0xF8)
            fdst, count = struct.unpack_from(">II", raw, 0xC0)
            self.fdst = fdst if count > 1 else NONE
        self.exth: dict[int, list[bytes]] = {}
        if self.flags & 0x40:
            self._extended(raw, self.size + 16, options.max_exth)
        self.name = self.text(raw[name_at : name_at + name_size]) if name_at + name_size <= len(raw) else ""

    def _extended(self, raw: bytes, at: int, most: int) -> None:
        if at + 12 > len(raw):
            raise Corrupt("mobi: extended header is cut off")
        (count,) = struct.unpack_from(">I", raw, at + 8)
        at += 12
        for _ in range(min(count, most)):
            if at + 8 > len(raw):
                raise Corrupt("mobi: extended record is cut off")
            kind, size = struct.unpack_from(">II", raw, at)
            if size < 8 or at + size > len(raw):
                raise Corrupt("mobi: extended record has a bad size")
            self.exth.setdefault(kind, []).append(raw[at + 8 : at + size])
            at += size

    def text(self, raw: bytes) -> str:
        return raw.decode("utf-8" if self.codec == "utf-8" else "cp1252", "replace").strip().strip("\0")

    def values(self, kind: int) -> list[str]:
        return [t for raw in self.exth.get(kind, []) if (t := self.text(raw))]

    def number(self, kind: int) -> int | None:
        raw = self.exth.get(kind, [b""])[0]
        return int.from_bytes(raw[:4], "big") if len(raw) >= 4 else None

    @property
    def protected(self) -> bool:
        return self.drm != NONE or self.encryption != 0


def _trailing(record: bytes, flags: int) -> int:
    """Bytes of the entries that follow a record's text."""
    size, gone = len(record), 0
    for bit in range(1, 16):
        if flags >> bit & 1:
            at, shift, value = size - gone, 0, 0
            while at > 0 and shift < 28:
                at -= 1
                value |= (record[at] & 0x7F) << shift
                shift += 7
                if record[at] & 0x80:
                    break
            gone += value
    if flags & 1 and 0 <= size - gone - 1 < size:
        gone += (record[size - gone - 1] & 3) + 1
    return min(gone, size)


def raw_text(db: PalmDatabase, h: Header, base: int, limit: int) -> bytes:
    """All text records from the one after `base`, unpacked and cleaned."""
    huff = Huff(db[h.huff], [db[h.huff + i] for i in range(1, h.huff_count)]) if h.compression == 17480 else None
    out = bytearray()
    for i in range(1, h.text_records + 1):
        if base + i >= len(db):
            break
        record = db[base + i]
        record = record[: len(record) - _trailing(record, h.extra)]
        room = limit - len(out)
        if h.compression == 17480:
            out += huff.unpack(record, room)
        elif h.compression in (2, 257):
            out += palmdoc(record, room)
        else:
            out += record
        if len(out) > limit:
            raise OverLimit(f"text is over {limit} bytes")
    return _clean(bytes(out), h.codec)


def _clean(text: bytes, codec: str) -> bytes:
    text = text.removesuffix(b"#").replace(b"\0", b"")
    return text.replace(b"\x1e", b"").replace(b"\x02", b"") if codec == "windows-1252" else text


class Index:
    """An INDX record with its entries: (name, {tag: values})."""

    def __init__(self, db: PalmDatabase, at: int) -> None:
        head = db[at]
        if head[:4] != b"INDX" or len(head) < 56:
            raise Corrupt("mobi: bad index")
        tagx, count = struct.unpack_from(">I", head, 4)[0], struct.unpack_from(">I", head, 24)[0]
        (labels,) = struct.unpack_from(">I", head, 52)
        if head[tagx : tagx + 4] != b"TAGX":
            raise Corrupt("mobi: index without tags")
        end, self.control = struct.unpack_from(">II", head, tagx + 4)
        self.tags = [tuple(head[i : i + 4]) for i in range(tagx + 12, min(tagx + end, len(head) - 3), 4)]
        self.entries: list[tuple[bytes, dict[int, list[int]]]] = []
        for n in range(1, count + 1):
            self._read(db[at + n])
        self.labels = [db[at + count + 1 + n] for n in range(labels) if at + count + 1 + n < len(db)]

    def _read(self, raw: bytes) -> None:
        if raw[:4] != b"INDX":
            raise Corrupt("mobi: bad index record")
        table, count = struct.unpack_from(">II", raw, 20)
        if table + 4 + 2 * count > len(raw):
            raise Corrupt("mobi: index offsets are cut off")
        places = [*struct.unpack_from(f">{count}H", raw, table + 4), table]
        for a, b in zip(places, places[1:], strict=False):
            if a >= b or a + 1 + raw[a] > b:
                continue
            self.entries.append((raw[a + 1 : a + 1 + raw[a]], self._values(raw[a + 1 + raw[a] : b])))

    def _values(self, raw: bytes) -> dict[int, list[int]]:
        at, control, wanted, out = self.control, 0, [], {}
        for tag, per, mask, last in self.tags:
            if last:
                control += 1
                continue
            value = raw[control] & mask if control < len(raw) else 0
            if value == mask and bin(mask).count("1") > 1:
                size, at = self.number(raw, at)
                wanted.append((tag, per, None, size))
            elif value:
                while not mask & 1:
                    mask, value = mask >> 1, value >> 1
                wanted.append((tag, per, value, None))
        for tag, per, times, size in wanted:
            values, end = [], at + (size or 0)
            while (len(values) < per * times) if times is not None else at < end:
                if at >= len(raw):
                    break
                value, at = self.number(raw, at)
                values.append(value)
            out[tag] = values
        return out

    @staticmethod
    def number(raw: bytes, at: int) -> tuple[int, int]:
        """A number of 7 bits a byte, the last one marked."""
        value = 0
        for _ in range(5):
            if at >= len(raw):
                break
            value = value << 7 | raw[at] & 0x7F
            at += 1
            if raw[at - 1] & 0x80:
                break
        return value, at


def _parts(db: PalmDatabase, h: Header, base: int, text: bytes) -> list[bytes]:
    """KF8 text put together: skeletons with their fragments inserted."""
    flows = [(0, len(text))]
    if h.fdst != NONE:
        raw = db[base + h.fdst]
        if raw[:4] != b"FDST":
            raise Corrupt("kf8: bad flow table")
        start, count = struct.unpack_from(">II", raw, 4)
        if start + 8 * count > len(raw):
            raise Corrupt("kf8: flow table is cut off")
        flows = [struct.unpack_from(">II", raw, start + 8 * i) for i in range(count)]
    main = text[flows[0][0] : flows[0][1]] if flows else text
    if h.skel == NONE or h.div == NONE:
        return [main]
    skeletons = Index(db, base + h.skel).entries
    fragments = Index(db, base + h.div).entries
    out, used = [], 0
    for _, tags in skeletons:
        place, size = (tags.get(6, [0, 0]) + [0, 0])[:2]
        part, at = main[place : place + size], place + size
        for name, own in fragments[used : used + (tags.get(1, [0]) or [0])[0]]:
            length = (own.get(6, [0, 0]) + [0, 0])[1]
            if not name.isdigit():
                raise Corrupt("kf8: bad fragment")
            into = max(0, min(int(name) - place, len(part)))
            part, at = part[:into] + main[at : at + length] + part[into:], at + length
        used += (tags.get(1, [0]) or [0])[0]
        out.append(part)
    return out


def _metadata(book: Book, halves: list[Header], fallback: str) -> None:
    """Fields of the KF8 half first, then of the other."""
    best = lambda kind: next((v for h in halves if (v := h.values(kind))), [])
    one = lambda kind: (best(kind) or [""])[0]
    book.title = one(TITLE) or next((h.name for h in halves if h.name), "") or fallback
    book.authors, book.subjects = best(AUTHOR), split_subjects(best(SUBJECT))
    book.publisher, book.description, book.publication_date = one(PUBLISHER), one(DESCRIPTION), one(DATE)
    language = next((tag for h in halves if (tag := palm_language(h.locale))), "")
    book.languages = best(LANGUAGE) or ([language] if language else [])
    for h in halves:
        pairs = [("ISBN", split_identifier(v, "ISBN")[1]) for v in h.values(ISBN)]
        pairs += [p for v in h.values(SOURCE) if (p := split_identifier(v))[0].lower() in ("isbn", "calibre")]
        pairs += [("ASIN", v) for v in h.values(ASIN) or h.values(ASIN_2)]
        book.identifiers = list(dict.fromkeys(p for p in pairs if p[1]))
        if book.identifiers:
            break


def _images(db: PalmDatabase, book: Book, first: int, cover: int | None, options: Options) -> None:
    if not first or first >= len(db):
        return
    number = 0
    for i in range(first, len(db)):
        raw = db[i]
        mime, extension = image_type(raw)
        if mime in ("application/octet-stream", "image/svg+xml"):
            continue
        number += 1
        name = f"image{i - first + 1:05d}.{extension}"
        r = Resource(id=f"image{i - first + 1:05d}", name=name, media_type=mime, href=f"images/{name}", resolved_href=f"images/{name}", size=len(raw), content=raw if options.with_content else None)
        if cover is not None and i == first + cover:
            r.properties, book.cover = "cover-image", r
        book.resources.append(r)


def _add_text(book: Book, name: str, data: bytes, mime: str, codec: str, options: Options) -> None:
    r = Resource(id=name.rpartition(".")[0], name=name, media_type=mime, href=name, resolved_href=name, charset=codec, size=len(data), content=data if options.with_content else None)
    book.resources.append(r)
    book.order.append((r, True))


_PAGE = re.compile(rb"<(?:html|head|body)[\s/>]", re.I)


def read_palmdoc(db: PalmDatabase, options: Options) -> Book:
    """Every record after the first is text; a page of markup may carry metadata of its own."""
    raw = db[0]
    if len(raw) < 16:
        raise Corrupt("palmdoc: header is cut off")
    compression, encryption = struct.unpack_from(">H", raw)[0], struct.unpack_from(">H", raw, 12)[0]
    if encryption:
        raise Protected("palmdoc: encrypted")
    out = bytearray()
    for i in range(1, len(db)):
        out += palmdoc(db[i], options.max_resource - len(out)) if compression == 2 else db[i]
        if len(out) > options.max_resource:
            raise OverLimit("text is over the limit")
    text = bytes(out).replace(b"\0", b"").replace(b"\x0e", b"")
    book = Book(file_type="palmdoc", version="1", title=db.name.decode("cp1252", "replace").strip())
    page = bool(_PAGE.search(text[:4096].lstrip()))
    if page and (m := re.search(rb"<metadata[\s>].*?</metadata>", text, re.I | re.S)):
        try:
            found = Book()
            opf.metadata(opf.read(b"<package>" + m[0] + b"</package>"), found)
            for name in ("title", "authors", "description", "subjects", "languages", "identifiers", "publisher", "publication_date"):
                if value := getattr(found, name):
                    setattr(book, name, value)
        except Corrupt:
            pass
    _add_text(book, "content.html" if page else "content.txt", text, MOBI_HTML if page else PLAIN, "windows-1252", options)
    return book


def read_mobi(data: bytes, options: Options) -> Book:
    db = PalmDatabase(data, options)
    if not len(db):
        raise Corrupt("mobi: no records")
    if db.kind.upper() == b"TEXTREAD":
        return read_palmdoc(db, options)
    first = Header(db[0], options)
    second, base = None, first.number(KF8_AT) or 0
    if 1 < base < len(db) and db[base - 1] == b"BOUNDARY":
        second = Header(db[base], options)
        if second.huff_count:
            second.huff += base
    halves = [second, first] if second else [first]
    if any(h.protected for h in halves):
        raise Protected("mobi: encrypted")
    book = Book(file_type="mobi", version="6/8" if second else str(first.version) if first.version in (6, 8) else "")
    _metadata(book, halves, db.name.decode("cp1252", "replace").strip())
    kf8, at = (second, base) if second else (first if first.version == 8 else None, 0)
    parts = None
    if kf8 is not None:
        try:
            text = raw_text(db, kf8, at, options.max_resource)
            try:
                parts = _parts(db, kf8, at, text)
            except (Corrupt, struct.error, IndexError):
                parts = [text]  # a broken index leaves the markup as one part
        except (OverLimit, Protected):
            raise
        except BookError:
            if second is None or not options.mobi6_fallback:
                raise
    if parts is not None:
        for i, part in enumerate(parts):
            _add_text(book, f"part{i:04d}.html" if part else f"empty-{i}.html", part, HTML_TYPES[1], kf8.codec, options)
    else:
        _add_text(book, "content.html", raw_text(db, first, 0, options.max_resource), MOBI_HTML, first.codec, options)
    cover = next((n for h in halves if (n := h.number(COVER)) is not None and n != NONE), None)
    _images(db, book, first.first_image if first.first_image != NONE else 0, cover, options)
    return book


def read_ereader(data: bytes, options: Options) -> Book:
    db = PalmDatabase(data, options)
    if not len(db):
        raise Corrupt("ereader: no records")
    raw = db[0]
    book = Book(file_type="ereader", version=str(len(raw)))
    word = lambda at: struct.unpack_from(">H", raw, at)[0]
    drop = len(raw) == 132
    if not drop and len(raw) < 10:
        raise Corrupt("ereader: header is cut off")
    if drop and word(0) in (260, 272):
        raise Protected("ereader: encrypted")
    pages = max(word(12 if drop else 8) - 1, 0)

    def page(record: bytes, room: int) -> bytes:
        if not drop:
            return palmdoc(bytes(c ^ 0xA5 for c in record), room)
        if word(0) == 2:
            return palmdoc(record, room)
        if word(0) == 10:
            return inflate(record, room)
        raise Corrupt(f"ereader: compression {word(0)}")

    def add(name: str, start: int, count: int, linear: bool) -> None:
        span = range(start, min(start + count, len(db)))
        if not span and not linear:
            return
        r = Resource(id=name.partition(".")[0] if not linear else "content", name=name, media_type=PML, href=name, resolved_href=name, charset="windows-1252", size=sum(len(db[i]) for i in span))
        try:
            out = bytearray()
            for i in span:
                out += page(db[i], options.max_resource - len(out))
            r.content = bytes(out) if options.with_content else None
        except BookError as e:
            r.error_code, r.error_msg = e.code, str(e)
        book.resources.append(r)
        book.order.append((r, linear))

    add("index.pml", 1, pages, True)
    if drop:
        add("footnotes.pml", max(word(48) + 1, 2), max(word(28) - 1, 0), False)
        add("sidebars.pml", max(word(50) + 1, 2), max(word(30) - 1, 0), False)
    span = range(word(40), word(40) + word(20)) if drop else range(pages + 1, len(db))
    left = len(db) if drop else word(116) if len(raw) >= 118 else len(db)
    for i in span:
        if not 0 < i < len(db) or left <= 0 or len(db[i]) < 78 or db[i][:3] != b"PNG":
            continue
        name, content = db[i][4:36].partition(b"\0")[0].decode("cp1252", "replace").strip(), db[i][62:]
        if name:
            r = Resource(id=f"image-{i:05d}", name=name, media_type=image_type(content)[0], href=f"images/{name}", resolved_href=f"images/{name}", size=len(content), content=content if options.with_content else None)
            if name.lower() == "cover.png" and book.cover is None:
                r.properties, book.cover = "cover-image", r
            book.resources.append(r)
            left -= 1
    at = word(44) if drop and word(24) == 1 else 0
    fields = [f.decode("cp1252", "replace").strip() for f in db[at].split(b"\0")] if 0 < at < len(db) else []
    get = lambda i: fields[i] if i < len(fields) else ""
    book.title = get(0) or db.name.decode("cp1252", "replace").strip()
    book.authors = [get(1)] if get(1) else []
    book.publisher = get(3)
    if get(4):
        book.identifiers.append(("ISBN", split_identifier(get(4), "ISBN")[1]))
    return book
