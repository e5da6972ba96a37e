"""LIT: a container of packed sections, a manifest of internal names, and markup in binary form."""

from __future__ import annotations

import html
import posixpath
import re
import struct
from collections.abc import Callable
from urllib.parse import unquote

from codexa.sources import opf
from codexa.sources.lit_names import PACKAGE, PACKAGE_ATTRIBUTES, PAGE, attribute
from codexa.sources.lzx import decompress
from codexa.sources.model import Book, BookError, Corrupt, Options, OverLimit, Protected, Unsupported, clean_href

# The container's marks, names and transforms.
MAGIC, HEAD = b"ITOLITLS", 40
META, MANIFEST, NAMES, STORAGE, LICENCE = "/meta", "/manifest", "::DataSpace/NameList", "::DataSpace/Storage/", "/DRMStorage/Licenses/EUL"
SEALED, PACKED = "{67F6E4A2-60BF-11D3-8540-00C04F58C3CF}", "{0A9007C6-4076-11D3-8789-0000F8105754}"
# Flags of a binary record, the number that stands for a name written out, and the length that stands for a number.
OPENS, CLOSES, ATOM = 0x01, 0x02, 0x10
WRITTEN, NUMERIC = 0x8000, 0xFFFF
# Kinds of files, in the order of the manifest.
STATES = ("spine", "not spine", "css", "images")
# What a decoded page begins with, and elements of a word processor that are left out of it.
DECLARED = '<?xml version="1.0" encoding="UTF-8" ?>\n<!DOCTYPE html PUBLIC\n "+//ISBN 0-9673008-1-9//DTD OEB 1.0.1 Document//EN"\n "http://openebook.org/dtds/oeb-1.0.1/oebdoc101.dtd">\n'
SMART = ("st1:personname", "st1:place", "st1:city", "st1:country-region")
_SMART = re.compile("|".join(f"<{end}{name}>" for name in SMART for end in ("", "/")), re.I)
_BARE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z_:][\w.:-]*;)", re.A)


def supports(data: bytes) -> bool:
    return len(data) >= HEAD and data.startswith(MAGIC)


class Container:
    """Directory and sections of a file."""

    def __init__(self, data: bytes, options: Options) -> None:
        self.data, self.limit = data, options.max_resource
        version, head, _, pieces, second = struct.unpack_from("<Iiiii", data, 8) if len(data) >= HEAD else (0, 0, 0, 0, 0)
        if version != 1 or head < 0 or second <= 0 or not 2 <= pieces <= 1 << 20 or head + 16 * pieces + second > len(data):
            raise Corrupt("lit: bad header")
        self.base = self._content_at(data[head + 16 * pieces : head + 16 * pieces + second])
        at, high, size, high_size = struct.unpack_from("<IIiI", data, head + 16)
        if high or high_size or size < 0 or at + size > len(data):
            raise Corrupt("lit: the directory does not fit")
        self.entries = self._directory(data[at : at + size])
        if LICENCE in self.entries:
            raise Protected("lit: bound to a licence")
        self._sections: dict[int, bytes] = {}
        self.names = self._names(self.read(NAMES))

    @staticmethod
    def _content_at(raw: bytes) -> int:
        """Where unpacked content begins, from the blocks of the second header."""
        at, found = struct.unpack_from("<i", raw, 4)[0], None
        while 0 <= at < len(raw):
            kind, version, size = struct.unpack_from("<4sIi", raw, at)
            if kind == b"CAOL":
                size = 48
            elif kind == b"ITSF":
                found, high = struct.unpack_from("<II", raw, at + 16)
                if high:
                    raise Corrupt("lit: content beyond 4 GB")
            if version != {b"CAOL": 2, b"ITSF": 4}.get(kind, version) or size <= 0:
                raise Corrupt(f"lit: bad block {kind!r}")
            at += size
        if at != len(raw) or found is None:
            raise Corrupt("lit: no place of content")
        return found

    @staticmethod
    def _directory(piece: bytes) -> dict[str, tuple[int, int, int]]:
        """Name -> (section, place, size)."""
        if piece[:4] != b"IFCM" or len(piece) < 32:
            raise Corrupt("lit: no directory")
        size, count = struct.unpack_from("<i", piece, 8)[0], struct.unpack_from("<i", piece, 24)[0]
        if size < 50 or count < 0 or 32 + size * count != len(piece):
            raise Corrupt("lit: bad directory")
        out: dict[str, tuple[int, int, int]] = {}
        for i in range(count):
            sheet = piece[32 + i * size : 32 + (i + 1) * size]
            if sheet[:4] != b"AOLL":
                continue
            (free,) = struct.unpack_from("<i", sheet, 4)
            if not 0 <= free < size:
                raise Corrupt("lit: bad directory page")
            at, end = 48, size - free
            for _ in range(struct.unpack_from("<H", sheet, size - 2)[0] or 0xFFFF):
                if at >= end:
                    break
                numbers = []
                length, at = _number(sheet, at, end)
                name, at = sheet[at : at + length], at + length
                for _ in range(3):
                    value, at = _number(sheet, at, end)
                    numbers.append(value)
                try:
                    out[name.decode()] = tuple(numbers)
                except UnicodeDecodeError:
                    break
        return out

    @staticmethod
    def _names(raw: bytes) -> list[str]:
        out, at = [], 4
        for _ in range(struct.unpack_from("<H", raw, 2)[0]):
            size = 2 * struct.unpack_from("<H", raw, at)[0] + 2
            if at + 2 + size > len(raw):
                raise Corrupt("lit: section names are cut off")
            out.append(raw[at + 2 : at + 2 + size].decode("utf-16-le", "replace").rstrip("\0"))
            at += 2 + size
        return out

    def read(self, name: str) -> bytes:
        if name not in self.entries:
            raise Corrupt(f"lit: no entry {name}")
        section, place, size = self.entries[name]
        if size > self.limit:
            raise OverLimit(f"{name} is over {self.limit} bytes")
        source, place = (self._section(section), place) if section else (self.data, self.base + place)
        if place + size > len(source):
            raise Corrupt(f"lit: entry {name} is cut off")
        return source[place : place + size]

    def _section(self, number: int) -> bytes:
        if number not in self._sections:
            if number >= len(self.names):
                raise Corrupt(f"lit: no section {number}")
            folder = STORAGE + self.names[number]
            transforms, content, control = (self.read(folder + part) for part in ("/Transform/List", "/Content", "/ControlData"))
            for at in range(0, len(transforms) - 15, 16):
                size = 4 * (struct.unpack_from("<i", control)[0] + 1)
                if not 0 < size <= len(control):
                    raise Corrupt("lit: control data is cut off")
                kind = _guid(transforms[at : at + 16])
                if kind == SEALED:
                    raise Protected("lit: sealed content")
                if kind != PACKED:
                    raise Unsupported(f"lit: unknown transform {kind}")
                content = self._unpacked(content, control[:size], self.read(f"{folder}/Transform/{PACKED}/InstanceData/ResetTable"))
                control = control[size:]
            self._sections[number] = content
        return self._sections[number]

    def _unpacked(self, packed: bytes, control: bytes, table: bytes) -> bytes:
        """A section whose decoder starts afresh with every window."""
        if control[4:8] != b"LZXC" or len(control) < 32 or len(table) < 40:
            raise Corrupt("lit: bad compression data")
        bits = 14 + struct.unpack_from("<I", control, 12)[0].bit_length()
        head, total, high, frame = (struct.unpack_from("<i", table, at)[0] for at in (12, 16, 20, 32))
        if not 15 <= bits <= 21 or total < 0 or high or frame <= 0 or head < 0:
            raise Corrupt("lit: bad reset table")
        if total > self.limit:
            raise OverLimit(f"a section is over {self.limit} bytes")
        window, step = 1 << bits, -(-(1 << bits) // frame)
        places = [p for (p,) in struct.iter_unpack("<q", table[head : head + (len(table) - head) // 8 * 8])]
        out, base = bytearray(), 0
        for end in places[step::step]:
            if not base <= end <= len(packed):
                raise Corrupt("lit: bad reset place")
            if total - len(out) >= window:
                out += decompress(packed[base:end], bits, window)
                base = end
        if total > len(out):
            out += decompress(packed[base:], bits, total - len(out))
        return bytes(out)


def _number(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = 0
    for _ in range(10):
        if at >= end:
            break
        value, at = value << 7 | data[at] & 0x7F, at + 1
        if data[at - 1] < 0x80:
            return value, at
    raise Corrupt("lit: bad number")


def _guid(raw: bytes) -> str:
    a, b, c = struct.unpack_from("<IHH", raw)
    return f"{{{a:08X}-{b:04X}-{c:04X}-{raw[8:10].hex()}-{raw[10:16].hex()}}}".upper()


class _Reader:
    """Strings whose length is a character in front."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.raw):
            raise Corrupt("lit: data is cut off")
        self.at += size
        return self.raw[self.at - size : self.at]

    def char(self) -> str:
        first = self.take(1)
        size = 1 if first[0] < 0x80 else 2 if first[0] < 0xE0 else 3 if first[0] < 0xF0 else 4
        return (first + self.take(size - 1)).decode()

    def string(self) -> str:
        return "".join(self.char() for _ in range(ord(self.char())))

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def output_path(original: str) -> str:
    """A file's path as it is stored: no drive, no way up in front."""
    path = original.replace("\\", "/")
    path = posixpath.normpath(path[2:] if re.match(".:/", path) else path)
    path = "/" + path.lstrip("/") if path.startswith("/") else path
    return re.sub(r"^(?:\.\./)+", "", path)


def without_shared(paths: dict[str, str]) -> dict[str, str]:
    """Paths without the folders that all have in common; what is still rooted keeps its name only."""
    if len(paths) < 2:
        return paths
    every = list(paths.values())
    shared = posixpath.commonprefix(every)
    if any(p != shared for p in every):
        shared = shared[: shared.rfind("/") + 1]
    short = {k: v[len(shared) :] for k, v in paths.items()}
    return {k: posixpath.basename(v) if v.startswith("/") else v for k, v in short.items()}


def manifest(raw: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Internal name -> path, and -> kind."""
    data, paths, kinds = _Reader(raw), {}, {}
    while data.at < len(raw) and (size := data.take(1)[0]):
        data.take(size).decode()
        for state in STATES:
            for _ in range(data.number()):
                data.take(4)
                internal, original = data.string(), data.string()
                data.string()  # the media type; the package has it too
                if raw[data.at : data.at + 1] == b"\0":
                    data.at += 1
                paths[internal], kinds[internal] = output_path(unquote(original)), state
    return without_shared(dict(sorted(paths.items()))), kinds


def atoms(raw: bytes) -> tuple[dict[int, str], dict[int, str]]:
    """Names of a page's own elements and attributes; a damaged table gives what comes before."""
    data, found = _Reader(raw), ({}, {})
    try:
        for names, size in zip(found, (lambda: data.take(1)[0], data.number), strict=True):
            for i in range(1, data.number() + 1):
                length = size()
                if length <= 0:
                    return found
                names[i] = data.take(length).decode("utf-8", "replace")
    except BookError:
        pass
    return found


def target(href: str, paths: dict[str, str], folder: str) -> str:
    """An internal link, of which the first character says nothing, as a link from a folder."""
    name, mark, fragment = href[1:].partition("#")
    path = paths.get(name, name)
    if folder:
        here, there = folder.split("/"), path.split("/")
        same = 0
        while same < min(len(here), len(there)) and here[same] == there[same]:
            same += 1
        path = "/".join([".."] * (len(here) - same) + there[same:])
    return path + (mark + fragment if fragment else "")


def _plain(text: str) -> str:
    """Text as markup: numbers for what is not ASCII, entities for what is reserved; comments and entities stay."""
    text = re.sub("<(?!!--)", "&lt;", _BARE.sub("&amp;", text.replace("\v", "\n"))).replace(">", "&gt;")
    return text.encode("ascii", "xmlcharrefreplace").decode()


def _value(text: str) -> str:
    return _BARE.sub("&amp;", text).replace('"', "&quot;").replace("<", "&lt;").encode("ascii", "xmlcharrefreplace").decode()


def markup(binary: bytes, elements: dict[int, str], names: Callable[[str, int], str], paths: dict[str, str], own: tuple[dict, dict] = ({}, {}), page: str = "") -> str:
    """Binary markup as text. A NUL begins a record: flags, an element's number, its attributes up to a NUL; the rest is text."""
    try:
        text = binary.decode()
    except UnicodeDecodeError as e:
        raise Corrupt(f"lit: {e}") from e
    folder = posixpath.dirname(page)
    out: list[str] = []
    open_: list[str] = []
    at = 0

    def char() -> str:
        nonlocal at
        if at >= len(text):
            raise EOFError
        at += 1
        return text[at - 1]

    def chars(count: int) -> str:
        nonlocal at
        if not 0 <= count <= len(text) - at:
            raise Corrupt(f"lit: bad number of characters {count}")
        at += count
        return text[at - count : at]

    def value() -> str:
        size = ord(char())
        return str(ord(char()) - 1) if size == NUMERIC else chars(size - 1)

    def attributes(element: str, atom: bool) -> None:
        while number := ord(char()):
            if number == WRITTEN:
                name = chars(ord(char()) - 1)
            else:
                name = (own[1].get(number) if atom else None) or names(element, number)
            if not name:
                raise Corrupt(f"lit: unknown attribute {number} of {element}")
            if name.startswith("%"):
                value()
            elif number != WRITTEN and name in ("href", "src"):
                out.append(f' {name}="{_value(target(chars(ord(char()) - 1), paths, folder))}"')
            else:
                out.append(f' {_value(name)}="{_value(value())}"')

    try:
        while at < len(text):
            if text[at] != "\0":
                end = text.find("\0", at)
                end = len(text) if end < 0 else end
                out.append(_plain(text[at:end]))
                at = end
                continue
            at += 1
            flags = ord(char())
            if not flags:
                continue
            number = ord(char())
            if flags & OPENS:
                if number == WRITTEN:
                    element = chars(ord(char()) - 1)
                else:
                    element = own[0].get(number, "") if flags & ATOM else elements.get(number, "")
                if not element:
                    raise Corrupt(f"lit: unknown element {number}")
                out.append("<" + _value(element))
                attributes(element, bool(flags & ATOM))
                if flags & CLOSES:
                    out.append(" />")
                else:
                    out.append(">")
                    open_.append(element)
            elif flags & CLOSES and open_:
                out.append(f"</{open_.pop()}>")
    except EOFError:
        pass  # a record that the data's end cuts off
    return "".join(out + [f"</{x}>" for x in reversed(open_)]).lstrip(" \t\n\r\v\f")


def repaired(package: str) -> str:
    """A package that closes before its manifest or spine, closed after them."""
    head, close, tail = package.partition("</package>")
    return head + tail.strip() + close if "<manifest" in tail or "<spine" in tail else package


def read(data: bytes, options: Options) -> Book:
    c = Container(data, options)
    paths, kinds = manifest(c.read(MANIFEST))
    text = repaired(markup(c.read(META), PACKAGE, lambda _, n: PACKAGE_ATTRIBUTES.get(n, ""), paths))
    package = opf.read(text.encode())
    book = Book(file_type="lit", version="1")
    opf.metadata(package, book)
    by_path: dict[str, str] = {}
    for internal in sorted(paths):
        by_path.setdefault(clean_href(paths[internal]), internal)

    def entry(internal: str) -> tuple[str, bool]:
        page = kinds.get(internal) not in ("css", "images")
        return f"/data/{internal}" + ("/content" if page else ""), page

    def lookup(path: str) -> str | None:
        internal = by_path.get(clean_href(html.unescape(path)))
        return internal if internal is not None and entry(internal)[0] in c.entries else None

    def load(internal: str, mime: str) -> dict:
        name, page = entry(internal)
        fields = {"size": c.entries[name][2], "charset": "utf-8" if page else ""}
        if not options.with_content:
            return fields
        try:
            content = c.read(name)
            if page:
                own = atoms(c.read(f"/data/{internal}/atom")) if f"/data/{internal}/atom" in c.entries else ({}, {})
                made = markup(content, PAGE, attribute, paths, own, paths[internal])
                content = (DECLARED + _SMART.sub("", made).replace("<form>", "<div>").replace("</form>", "</div>")).encode()
                if len(content) > options.max_resource:
                    raise OverLimit(f"{internal} is over {options.max_resource} bytes")
            return fields | {"content": content}
        except BookError as e:
            return fields | {"error_code": e.code, "error_msg": str(e)}

    opf.assemble(package, book, "content.opf", lookup, load)
    return book
