"""Compiled help: directory, LZX content, topics in the order of the table of contents."""

from __future__ import annotations

import html
import posixpath
import re
import struct

from codexa.functions import charset
from codexa.functions.strings import HELP_TYPES
from codexa.sources import help_page
from codexa.sources.locales import help_charset, help_language
from codexa.sources.lzx import FRAME, decompress
from codexa.sources.model import Book, Corrupt, Options, OverLimit, Resource

# Names of the compressed section's parts.
_SPACE = "::DataSpace/Storage/MSCompressed/"
CONTENT, CONTROL = _SPACE + "Content", _SPACE + "ControlData"
RESETS = _SPACE + "Transform/{7FC28940-9D31-11D0-9B27-00A0C91E9C7C}/InstanceData/ResetTable"


def supports(data: bytes) -> bool:
    if data[:4] != b"ITSF" or len(data) < 0x58:
        return False
    version, size = struct.unpack_from("<II", data, 4)
    return version in (2, 3) and (0x58 if version == 2 else 0x60) <= size <= len(data)


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for _ in range(10):
        if at >= len(data):
            break
        value = value << 7 | data[at] & 0x7F
        at += 1
        if not data[at - 1] & 0x80:
            return value, at
    raise Corrupt("chm: bad number")


class Archive:
    def __init__(self, data: bytes, options: Options) -> None:
        self.data, self.options = data, options
        self.version, size = struct.unpack_from("<II", data, 4)
        (self.language,) = struct.unpack_from("<I", data, 20)
        (directory,) = struct.unpack_from("<Q", data, 0x48)
        self.base = struct.unpack_from("<Q", data, 0x58)[0] if self.version == 3 else directory + struct.unpack_from("<Q", data, 0x50)[0]
        if data[directory : directory + 4] != b"ITSP" or directory + 0x54 > len(data):
            raise Corrupt("chm: no directory")
        head, chunk = struct.unpack_from("<I", data, directory + 8)[0], struct.unpack_from("<I", data, directory + 16)[0]
        (at,) = struct.unpack_from("<i", data, directory + 32)
        self.entries: dict[str, tuple[str, int, int, int]] = {}
        seen: set[int] = set()
        while at >= 0 and at not in seen:
            seen.add(at)
            page = data[directory + head + at * chunk : directory + head + (at + 1) * chunk]
            if page[:4] != b"PMGL" or len(page) != chunk:
                raise Corrupt("chm: bad directory page")
            free, following = struct.unpack_from("<I", page, 4)[0], struct.unpack_from("<i", page, 16)[0]
            self._page(page[20 : max(20, chunk - free)])
            at = following
        self._cache: bytes | None = None

    def _page(self, page: bytes) -> None:
        at = 0
        while at < len(page):
            size, at = _number(page, at)
            if size > 512 or at + size > len(page):
                raise Corrupt("chm: bad name")
            name = page[at : at + size].decode("utf-8", "replace")
            section, at = _number(page, at + size)
            place, at = _number(page, at)
            length, at = _number(page, at)
            self.entries.setdefault(name.lower(), (name, section, place, length))

    def __contains__(self, name: str) -> bool:
        return name.lower() in self.entries

    def read(self, name: str) -> bytes:
        if name.lower() not in self.entries:
            raise Corrupt(f"chm: no entry {name}")
        _, section, place, size = self.entries[name.lower()]
        if size > self.options.max_resource:
            raise OverLimit(f"{name} is over {self.options.max_resource} bytes")
        out = self.data[self.base + place : self.base + place + size] if section == 0 else self._content()[place : place + size]
        if len(out) < size:
            raise Corrupt(f"chm: entry {name} is cut off")
        return out

    def _content(self) -> bytes:
        """The whole compressed section, unpacked once; its decoder starts afresh at every reset."""
        if self._cache is not None:
            return self._cache
        control, table, packed = self.read(CONTROL), self.read(RESETS), self.read(CONTENT)
        if control[4:8] != b"LZXC" or len(control) < 24 or len(table) < 40:
            raise Corrupt("chm: bad compression data")
        version, interval, window, per = struct.unpack_from("<IIII", control, 8)
        if version == 2:
            interval, window = interval * FRAME, window * FRAME
        count, _, head = struct.unpack_from("<III", table, 4)
        total, used, block = struct.unpack_from("<QQQ", table, 16)
        if window < 2 or interval < window // 2 or block != FRAME or head + 8 * count > len(table) or total > 64 * self.options.max_resource:
            raise Corrupt("chm: bad reset table")
        step = max(1, interval // (window // 2) * max(1, per))
        places = [*struct.unpack_from(f"<{count}Q", table, head), used]
        out = bytearray()
        for i in range(0, count, step):
            end = places[min(i + step, count)]
            out += decompress(packed[places[i] : end], window.bit_length() - 1, min(step * FRAME, total - len(out)))
        self._cache = bytes(out)
        return self._cache


def _system(raw: bytes) -> dict[int, bytes]:
    out, at = {}, 4
    while at + 4 <= len(raw):
        code, size = struct.unpack_from("<HH", raw, at)
        out.setdefault(code, raw[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def topics(archive: Archive, words) -> list[tuple[str, str]]:
    """(path, title) of the topics in the order of the binary tables; none if a table is missing or broken."""
    names = ("/#TOPICS", "/#URLTBL", "/#URLSTR")
    if not all(n in archive for n in names):
        return []
    table, links, paths = (archive.read(n) for n in names)
    titles = archive.read("/#STRINGS") if "/#STRINGS" in archive else b""
    out = []
    for at in range(0, len(table) - 15, 16):
        title, link = struct.unpack_from("<II", table, at + 4)
        if link + 12 > len(links):
            continue
        (place,) = struct.unpack_from("<I", links, link + 8)
        if place + 8 < len(paths) and (path := topic(words(paths[place + 8 :]))):
            out.append((path, words(titles[title:]) if title < len(titles) else ""))
    return out


def topic(path: str) -> str | None:
    """A link's target within the archive."""
    path = re.split("[;#]", path.strip())[0].strip()
    if not path or "://" in path or re.match("(?i)(javascript|mailto):", path):
        return None
    return posixpath.normpath("/" + path.lstrip("/"))


_LOCAL = re.compile(r"<param\b[^>]*\bname\s*=\s*[\"']?local[\"']?[^>]*\bvalue\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)


def read(data: bytes, options: Options) -> Book:
    archive = Archive(data, options)
    book = Book(file_type="chm", version=str(archive.version))
    system = _system(archive.read("/#SYSTEM")) if "/#SYSTEM" in archive else {}
    language = struct.unpack_from("<I", system[4])[0] if len(system.get(4, b"")) >= 4 else archive.language
    fallback = help_charset(language)
    words = lambda raw: raw.partition(b"\0")[0].decode(charset.codec(fallback) or "cp1252", "replace").strip()
    book.languages = [tag] if (tag := help_language(language)) else []
    by_path: dict[str, Resource] = {}
    for name, _, _, size in archive.entries.values():
        if not name.startswith("/") or name.endswith("/") or name.startswith(("/#", "/$")):
            continue
        extension = name.rpartition(".")[2].lower()
        mime = HELP_TYPES.get(extension, "application/octet-stream")
        path = posixpath.normpath(name)
        r = Resource(id=path.lstrip("/"), name=posixpath.basename(name), media_type=mime, href=path.lstrip("/"), resolved_href=path.lstrip("/"), size=size)
        try:
            content = archive.read(name)
            if mime.startswith("text/") or mime.endswith("xml"):
                r.charset = charset.declared(content[:8192]) or fallback
            r.content = content if options.with_content else None
        except (Corrupt, OverLimit) as e:
            content, (r.error_code, r.error_msg) = b"", (e.code, str(e))
        book.resources.append(r)
        by_path.setdefault(path.lower(), r)
    start = topic(words(system.get(2, b"")))
    contents = [r for r in book.resources if r.name.lower().endswith(".hhc")]
    if contents:
        folder, stem = posixpath.split(start or "/")
        score = lambda r: (-(2 * (posixpath.dirname("/" + r.href) == folder) + (r.name.rpartition(".")[0].lower() == stem.rpartition(".")[0].lower()) - r.href.count("/")), r.href)
        chosen = min(contents, key=score)
        page = charset.decode(archive.read("/" + chosen.href), chosen.charset) if chosen.error_code is None else ""
        base = posixpath.dirname("/" + chosen.href)
        for m in _LOCAL.finditer(page):
            target = topic(html.unescape(m[1] or m[2] or ""))
            for path in (target, topic(posixpath.join(base, (target or "").lstrip("/")))):
                r = by_path.get((path or "").lower())
                if r and r.media_type in ("text/html", "application/xhtml+xml") and not r.name.lower().endswith((".hhc", ".hhk")):
                    if all(r is not o for o, _ in book.order):
                        book.order.append((r, True))
                    break
    home = by_path.get((start or "").lower())
    listed = topics(archive, words)
    if not book.order:
        found = [r for path, _ in listed if (r := by_path.get(path.lower())) and r.media_type in ("text/html", "application/xhtml+xml")]
        book.order = [(r, True) for i, r in enumerate(found) if all(r is not o for o in found[:i])]
    if not book.order and home:
        book.order.append((home, True))
    page = charset.decode(archive.read("/" + home.href), home.charset) if home and home.error_code is None else ""
    titled = re.search(r"<title[^>]*>(.*?)</title>", page, re.I | re.S)
    book.title = words(system.get(3, b"")) or (" ".join(html.unescape(titled[1]).split()) if titled else "") or next((t for path, t in listed if path == start and t), "")
    said = help_page.Page(page)
    author = next(iter(said.metas("author")), "")
    book.authors = [x for y in author.split(";") if (x := y.strip())]
    book.description = next(iter(said.metas("description")), "")
    book.publisher, book.publication_date, number = help_page.publisher(said), help_page.date(said), help_page.isbn(said)
    book.identifiers = [("ISBN", number)] if number else []
    shown = re.search(r"<img\b[^>]*\balt\s*=\s*[\"'][^\"']*cover[^\"']*[\"'][^>]*>", page, re.I)
    if shown and home and (m := re.search(r"\bsrc\s*=\s*[\"']([^\"']+)", shown[0], re.I)):
        book.cover = by_path.get(posixpath.normpath(posixpath.join("/" + posixpath.dirname(home.href), m[1])).lower())
    return book
