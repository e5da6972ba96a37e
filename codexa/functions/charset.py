"""Charsets: labels, what a document declares, decoding and encoding."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

UTF8, BINARY = "utf-8", "binary"
SNIFFED, PROLOG, HEAD = 8192, 2048, 8192

# Labels of the web's encoding standard that Python names otherwise or resolves otherwise.
WEB_LABELS = {
    "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "latin1": "windows-1252", "l1": "windows-1252", "iso-ir-100": "windows-1252", "x-cp1252": "windows-1252",
    "iso-8859-9": "windows-1254", "latin5": "windows-1254", "iso-8859-11": "windows-874", "tis-620": "windows-874", "dos-874": "windows-874",
    "gb2312": "gbk", "gb_2312-80": "gbk", "x-gbk": "gbk", "chinese": "gbk", "ks_c_5601-1987": "euc-kr", "korean": "euc-kr", "ksc5601": "euc-kr", "windows-949": "euc-kr",
    "shift-jis": "shift_jis", "sjis": "shift_jis", "ms_kanji": "shift_jis", "x-sjis": "shift_jis", "windows-31j": "shift_jis", "big5-hkscs": "big5", "cn-big5": "big5", "x-x-big5": "big5",
    "x-euc-jp": "euc-jp", "koi": "koi8-r", "koi8": "koi8-r", "koi8-ru": "koi8-u", "mac": "macintosh", "x-mac-roman": "macintosh", "x-mac-cyrillic": "x-mac-cyrillic", "cp866": "ibm866", "866": "ibm866",
    "unicode-1-1-utf-8": "utf-8", "unicode": "utf-16le", "ucs-2": "utf-16le", "iso-10646-ucs-2": "utf-16le",
}
# Encodings of that standard and Python's codec for each.
CODECS = {
    "utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf-16": "utf-16", "ibm866": "cp866", "koi8-r": "koi8-r", "koi8-u": "koi8-u", "macintosh": "mac-roman", "x-mac-cyrillic": "mac-cyrillic",
    "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs", "euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp", "shift_jis": "cp932", "euc-kr": "cp949", "windows-874": "cp874",
    **{f"windows-{n}": f"cp{n}" for n in range(1250, 1259)}, **{f"iso-8859-{n}": f"iso8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)},
}

_BLANK = b" \t\n\f\r"


def _attributes(tag: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name in lower case, value) of each attribute of a tag's inside; quotes are taken off, an attribute without a value has an empty one."""
    at, size = 0, len(tag)

    def skip(at: int, also: bytes = b"") -> int:
        while at < size and tag[at] in _BLANK + also:
            at += 1
        return at

    while (at := skip(at, b"/?")) < size:
        begin = at
        while at < size and tag[at] not in _BLANK + b"=/?":
            at += 1
        name, at = tag[begin:at].lower(), skip(at)
        if at >= size or tag[at] != ord("="):
            at += not name
            yield name, b""
            continue
        at = skip(at + 1)
        if at < size and tag[at] in b"'\"":
            end = tag.find(tag[at : at + 1], at + 1)
            end = size if end < 0 else end
            value, at = tag[at + 1 : end], end + 1
        else:
            begin = at
            while at < size and tag[at] not in _BLANK:
                at += 1
            value = tag[begin:at]
        yield name, value


def _tags(head: bytes, name: bytes) -> Iterator[bytes]:
    """The insides of the tags of a name, in any case, up to their >."""
    low = head.lower()
    at = low.find(b"<" + name)
    while at >= 0:
        begin = at + 1 + len(name)
        end = low.find(b">", begin)
        end = len(head) if end < 0 else end
        if head[begin : begin + 1] and head[begin] in _BLANK + b"/":
            yield head[begin:end]
        at = low.find(b"<" + name, begin)


def _of_xml(head: bytes) -> bytes:
    """The encoding of an XML declaration."""
    return next((value for tag in _tags(head, b"?xml") for name, value in _attributes(tag) if name == b"encoding" and value), b"")


def _of_html(head: bytes) -> bytes:
    """The charset of a meta element, its own attribute or part of its content."""
    for tag in _tags(head, b"meta"):
        for name, value in _attributes(tag):
            if name == b"content":
                _, found, rest = value.lower().partition(b"charset")
                rest = rest.lstrip(_BLANK)
                value = rest[1:].strip(_BLANK + b"'\"") if found and rest[:1] == b"=" else b""
            elif name != b"charset":
                continue
            label = value.split(b";")[0].strip(_BLANK + b"/").split()
            if label:
                return label[0]
    return b""


def normalize(label: str | None) -> str:
    """A label in lower case with common aliases folded; '' for none."""
    s = (label or "").strip().lower()
    if s in ("utf8", "ascii", "us-ascii"):
        return UTF8
    if re.fullmatch("cp[0-9]+", s) and codec("windows-" + s[2:]):
        return "windows-" + s[2:]
    return s


def codec(label: str) -> str | None:
    """Python's codec for a label, None if the label is unknown."""
    return CODECS.get(WEB_LABELS.get(label, label))


def declared(head: bytes) -> str | None:
    """Charset that a document's first bytes show or declare, None for UTF-8, unknown ones and none."""
    if head[:2] in (b"\xfe\xff", b"\0<"):
        return "utf-16be"
    if head[:2] in (b"\xff\xfe", b"<\0"):
        return "utf-16le"
    for find, limit in ((_of_xml, PROLOG), (_of_html, HEAD)):
        label = normalize(find(head[:limit]).decode("latin-1"))
        if label not in ("", UTF8) and codec(label):
            return label
    return None


def decode(data: bytes, hint: str | None = None, text: bool = True) -> str:
    """Bytes of a text resource as a string: a hint other than UTF-8 wins, else what the bytes declare.

    Invalid bytes become U+FFFD; an unknown label leaves UTF-8. A byte order mark of UTF-16 is dropped.
    """
    label = normalize(hint)
    if label in ("", UTF8) and text:
        label = declared(data[:SNIFFED]) or UTF8
    name = codec(label) or UTF8
    if name.startswith("utf-16"):
        if data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
            return data[2:].decode("utf-16-le" if data[:2] == codecs.BOM_UTF16_LE else "utf-16-be", "replace")
        name = "utf-16-be" if name == "utf-16" else name
    return data.decode(name, "replace")


def encode(text: str, label: str | None) -> bytes:
    """A string in a charset; UTF-16 gets a byte order mark; an unknown label is an error."""
    label = normalize(label)
    if label in ("", UTF8, BINARY):
        return text.encode()
    if label.startswith("utf-16"):
        little = label == "utf-16le"
        return (codecs.BOM_UTF16_LE if little else codecs.BOM_UTF16_BE) + text.encode("utf-16-le" if little else "utf-16-be", "replace")
    name = codec(label)
    if not name:
        raise LookupError(f"unknown charset {label!r}")
    return text.encode(name)
