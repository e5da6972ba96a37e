"""Book files made in memory, for queries and tests: containers, Palm databases, KF8 indexes, LRF objects, compiled help."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

UNSET = 0xFFFFFFFF
FRAME = 0x8000


def zipped(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def palm(kind: bytes, records: list[bytes], name: bytes = b"Name") -> bytes:
    head = name.ljust(32, b"\0") + bytes(28) + kind + struct.pack(">IIH", 0, 0, len(records))
    at, table = 78 + 8 * len(records), b""
    for i, r in enumerate(records):
        table += struct.pack(">II", at, i)
        at += len(r)
    return head + table + b"".join(records)


def mobi_header(text_records, compression=1, version=6, exth=(), drm=UNSET, first_image=UNSET, extra=0, name=b"Full", huff=(0, 0), fdst=UNSET, skel=UNSET, div=UNSET, language=9) -> bytes:
    records = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in exth)
    ext = b"EXTH" + struct.pack(">II", 12 + len(records), len(exth)) + records
    raw = bytearray(264)
    struct.pack_into(">HHIHHHH", raw, 0, compression, 0, 0, text_records, 4096, 0, 0)
    raw[16:20] = b"MOBI"
    struct.pack_into(">III", raw, 20, 248, 2, 65001)
    struct.pack_into(">I", raw, 36, version)
    struct.pack_into(">III", raw, 84, 264 + len(ext), len(name), language)
    struct.pack_into(">III", raw, 108, first_image, *huff)
    struct.pack_into(">I", raw, 128, 0x40)
    struct.pack_into(">I", raw, 168, drm)
    struct.pack_into(">II", raw, 0xC0, fdst, 2 if fdst != UNSET else 0)
    struct.pack_into(">H", raw, 242, extra)
    struct.pack_into(">II", raw, 0xF8, div, skel)
    return bytes(raw) + ext + name


def cut(data: bytes, size: int = 4096) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def lz77(data: bytes) -> bytes:
    """PalmDOC compression: the latest copy of three bytes or more, a space with the letter after it, plain bytes, runs of others."""
    out, at, seen = bytearray(), 0, {}
    while at < len(data):
        key, size = data[at : at + 3], 0
        back = at - seen.get(key, -9999)
        if len(key) == 3 and back <= 2047:
            size = 3
            while size < 10 and at + size < len(data) and data[at + size] == data[at + size - back]:
                size += 1
            out += (0x8000 | back << 3 | size - 3).to_bytes(2, "big")
        elif key[:1] == b" " and len(key) > 1 and 0x40 <= key[1] < 0x80:
            size = 2
            out.append(key[1] ^ 0x80)
        elif key[0] == 0 or 9 <= key[0] < 0x80:
            size = 1
            out.append(key[0])
        else:
            size = 1
            while size < 8 and at + size < len(data) and data[at + size] >= 0x80:
                size += 1
            out += bytes((size,)) + data[at : at + size]
        for i in range(at, at + size):
            seen[data[i : i + 3]] = i
        at += size
    return bytes(out)


def huffman() -> tuple[bytes, bytes]:
    """HUFF and CDIC records: 256 codes of eight bits, code 255 - i for byte i; entry 1 is coded itself and stands for "th"."""
    fast = b"".join(struct.pack(">I", 255 << 8 | 0x80 | 8) for _ in range(256))
    entries = [bytes([i]) for i in range(256)]
    entries[1] = bytes(255 - c for c in b"th")
    offsets, body = [], b""
    for i, e in enumerate(entries):
        offsets.append(512 + len(body))
        body += struct.pack(">H", len(e) | (0 if i == 1 else 0x8000)) + e
    return b"HUFF\0\0\0\x18" + struct.pack(">II", 24, 24 + 1024) + bytes(8) + fast + bytes(256), b"CDIC\0\0\0\x10" + struct.pack(">II", 256, 8) + struct.pack(">256H", *offsets) + body


def huffman_coded(data: bytes) -> bytes:
    return bytes(255 - c for c in data.replace(b"th", b"\1"))


def varint(n: int) -> bytes:
    """Seven bits a byte, the last one marked."""
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.append(n & 0x7F)
    return bytes(reversed(out))


def indx(entries, tags) -> list[bytes]:
    """An index of one record: (name, control byte, values) by tags."""
    table = bytes(x for t in tags for x in t) + bytes((0, 0, 0, 1))
    head = bytearray(56)
    head[:4] = b"INDX"
    struct.pack_into(">I", head, 4, 56)
    struct.pack_into(">I", head, 24, 1)
    first = bytes(head) + b"TAGX" + struct.pack(">II", 12 + len(table), 1) + table
    body, places = b"", []
    for name, control, values in entries:
        places.append(56 + len(body))
        body += bytes((len(name),)) + name + bytes((control,)) + b"".join(map(varint, values))
    head = bytearray(56)
    head[:4] = b"INDX"
    struct.pack_into(">II", head, 20, 56 + len(body), len(entries))
    return [first, bytes(head) + body + b"IDXT" + b"".join(struct.pack(">H", p) for p in places)]


def kf8(fragment: bytes = b"<p>inside</p>", **more) -> bytes:
    """A skeleton and one fragment that goes into its body."""
    skeleton = b"<html><body></body></html>"
    texts = cut(skeleton + fragment)
    skel = indx([(b"SKEL0", 3, [1, 0, len(skeleton)])], [(1, 1, 1, 0), (6, 2, 2, 0)])
    div = indx([(b"0000000012", 1, [0, len(fragment)])], [(6, 2, 1, 0)])
    n = len(texts)
    return palm(b"BOOKMOBI", [mobi_header(n, version=8, skel=n + 1, div=n + 3, **more), *texts, *skel, *div])


def tag(low: int, payload: bytes = b"") -> bytes:
    return bytes((low, 0xF5)) + payload


def lrf_text(*lines: str) -> bytes:
    """A text stream: a paragraph whose lines are apart."""
    return tag(0xA1, bytes(4)) + tag(0xD2).join(x.encode("utf-16-le") for x in lines)


def lrf(text: bytes, info: str, image: bytes, key: int = 0x30) -> bytes:
    """One page with one block; its text scrambled and packed; a thumbnail and a picture."""
    objects = {}

    def obj(name, kind, body):
        objects[name] = tag(0x00, struct.pack("<IH", name, kind)) + body + tag(0x01)

    def stream(raw, flags=0):
        if flags & 0x100:
            raw = struct.pack("<I", len(raw)) + zlib.compress(raw)
        if flags & 0x200:
            k = len(raw) % key + 0x0F
            raw = bytes(c ^ k for c in raw)
        return tag(0x54, struct.pack("<H", flags)) + tag(0x04, struct.pack("<I", len(raw))) + tag(0x05) + raw + tag(0x06)

    obj(1, 0x1C, tag(0x7B, struct.pack("<I", 2)))
    obj(2, 0x01, tag(0x5C, struct.pack("<HI", 1, 3)))
    obj(3, 0x02, stream(tag(0x03, struct.pack("<I", 4))))
    obj(4, 0x06, stream(tag(0x03, struct.pack("<I", 5))))
    obj(5, 0x0A, stream(text, 0x300))
    obj(6, 0x11, stream(image, 0x12))
    packed = zlib.compress(info.encode())
    head = bytearray(0x58)
    head[:8] = b"L\0R\0F\0\0\0"
    struct.pack_into("<HHI", head, 8, 999, key, 1)
    struct.pack_into("<H", head, 0x4C, len(packed) + 4)
    struct.pack_into("<HI", head, 0x4E, 0x12, len(image))
    data, table = bytes(head) + packed + image, b""
    for name, body in objects.items():
        table += struct.pack("<IIII", name, len(data), len(body), 0)
        data += body
    whole = bytearray(data + table)
    struct.pack_into("<QQ", whole, 0x10, len(objects), len(data))
    return bytes(whole)


class BitWriter:
    """16-bit little-endian units, the upper bits first."""

    def __init__(self) -> None:
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        self.bits.append(format(value, f"0{n}b") if n else "")

    def bytes(self) -> bytes:
        bits = "".join(self.bits)
        bits += "0" * (-len(bits) % 16)
        return b"".join(int(bits[i : i + 16], 2).to_bytes(2, "little") for i in range(0, len(bits), 16))


def lzx_literals(data: bytes, slots: int = 30) -> bytes:
    """A verbatim block of literals with 8-bit codes."""
    w = BitWriter()
    w.put(0, 1)
    w.put(1, 3)
    w.put(len(data), 24)
    small = lambda: [w.put(1 if s in (0, 9) else 0, 4) for s in range(20)]  # noqa: E731  symbol 0: '0', symbol 9: '1'
    small()
    w.put((1 << 256) - 1, 256)
    small()
    w.put(0, 8 * slots)
    small()
    w.put(0, 249)
    for c in data:
        w.put(c, 8)
    return w.bytes()


def lzx_plain(data: bytes) -> bytes:
    """An uncompressed block."""
    w = BitWriter()
    w.put(0, 1)
    w.put(3, 3)
    w.put(len(data), 24)
    return w.bytes() + struct.pack("<III", 1, 1, 1) + data + b"\0" * (len(data) & 1)


def chm(pages: dict[str, bytes], title: str = "Help", lcid: int = 0x409, start: str = "a.htm") -> bytes:
    """Compiled help; every frame of the content is packed on its own. Without a table of contents it has the binary tables."""
    content, entries = b"", []
    for name, data in pages.items():
        entries.append((name, 1, len(content), len(data)))
        content += data
    frames = [lzx_literals(x, slots=32) for x in cut(content, FRAME)]
    packed, places = b"".join(frames), [sum(map(len, frames[:i])) for i in range(len(frames))]
    system = [(2, start.encode() + b"\0"), (3, title.encode() + b"\0"), (4, struct.pack("<I", lcid))]
    plain = {
        "::DataSpace/Storage/MSCompressed/Content": packed,
        "::DataSpace/Storage/MSCompressed/ControlData": struct.pack("<I4sIIIII", 6, b"LZXC", 2, 1, 2, 1, 0),
        "::DataSpace/Storage/MSCompressed/Transform/{7FC28940-9D31-11D0-9B27-00A0C91E9C7C}/InstanceData/ResetTable": struct.pack("<IIIIQQQ", 2, len(places), 8, 40, len(content), len(packed), FRAME) + struct.pack(f"<{len(places)}Q", *places),
        "/#SYSTEM": struct.pack("<I", 3) + b"".join(struct.pack("<HH", k, len(v)) + v for k, v in system),
    }
    if not any(n.endswith(".hhc") for n in pages):
        paths = [n.lstrip("/") for n in pages]
        plain["/#STRINGS"] = b"\0Second\0First\0"
        plain["/#URLSTR"] = b"".join(bytes(8) + p.encode() + b"\0" for p in paths)
        starts = [sum(9 + len(p) for p in paths[:i]) for i in range(len(paths))]
        plain["/#URLTBL"] = b"".join(struct.pack("<III", 0, i, s) for i, s in enumerate(starts))
        plain["/#TOPICS"] = b"".join(struct.pack("<IIIHH", 0, t, 12 * i, 6, 0) for i, t in ((1, 1), (0, 8), (1, 1)))
        plain["/#SYSTEM"] = struct.pack("<I", 3) + struct.pack("<HH", 2, 6) + b"a.htm\0"
    store = b""
    for name, data in plain.items():
        entries.append((name, 0, len(store), len(data)))
        store += data

    def number(n):
        out = bytes((n & 0x7F,))
        while n := n >> 7:
            out = bytes((n & 0x7F | 0x80,)) + out
        return out

    rows, sheets = [b""], []
    for n, s, at, size in sorted(entries, key=lambda e: e[0].lower()):
        row = number(len(n)) + n.encode() + number(s) + number(at) + number(size)
        if len(rows[-1]) + len(row) > 4096 - 20:
            rows.append(b"")
        rows[-1] += row
    for i, row in enumerate(rows):
        sheets.append(b"PMGL" + struct.pack("<IIii", 4096 - 20 - len(row), 0, i - 1, i + 1 if i + 1 < len(rows) else -1) + row.ljust(4096 - 20, b"\0"))
    directory = b"ITSP" + struct.pack("<IIIIIIiiiII", 1, 0x54, 10, 4096, 2, 1, -1, 0, len(sheets) - 1, 1, 0x409) + bytes(0x54 - 48) + b"".join(sheets)
    base = 0x60 + len(directory)
    head = b"ITSF" + struct.pack("<IIIII", 3, 0x60, 1, 0, lcid) + bytes(32) + struct.pack("<QQQQQ", 0x60, 0, 0x60, len(directory), base)
    return head + directory + store


def record(flags: int, number: int = 0, *attributes: tuple[int, str]) -> str:
    """A record of binary markup; an attribute is its number and value."""
    inside = "".join(chr(n) + chr(len(v) + 1) + v for n, v in attributes)
    return "\0" + chr(flags) + chr(number) + (inside + "\0" if flags & 1 else "")


def element(number: int, *inside: str, attributes: tuple = ()) -> str:
    return record(1, number, *attributes) + "".join(inside) + record(2)


def lit(meta: str, files: dict[str, tuple[str, str]], more: dict[str, bytes] | None = None, state: str = "spine") -> bytes:
    """A package in binary markup and pages, internal name -> (stored path, binary markup), packed frame by frame."""
    sized = lambda text: chr(len(text)).encode() + text.encode()
    rows = b"".join(struct.pack("<I", 0) + sized(name) + sized(path) + sized("text/html") + b"\0" for name, (path, _) in files.items())
    counts = {"spine": 0, "not spine": 1, "css": 2, "images": 3}
    groups = [struct.pack("<i", len(files)) + rows if i == counts[state] else struct.pack("<i", 0) for i in range(4)]
    content, entries = b"", []
    for name, (_, binary) in files.items():
        data = binary.encode()
        entries.append((f"/data/{name}/content", 1, len(content), len(data)))
        content += data
    frames = [lzx_literals(x, slots=30) for x in cut(content, FRAME)]
    places = [sum(map(len, frames[:i])) for i in range(len(frames))]
    folder = "::DataSpace/Storage/MSCompressed"
    guid = bytes.fromhex("C607900A 7640 D311 8789 0000F8105754".replace(" ", ""))
    names = b"".join(struct.pack("<H", len(n)) + n.encode("utf-16-le") + b"\0\0" for n in ("Uncompressed", "MSCompressed"))
    plain = {
        "/meta": meta.encode(), "/manifest": b"\1r" + b"".join(groups) + b"\0", "::DataSpace/NameList": struct.pack("<HH", 0, 2) + names, f"{folder}/Transform/List": guid, f"{folder}/Content": b"".join(frames),
        f"{folder}/ControlData": struct.pack("<I4sIIIIII", 7, b"LZXC", 2, 1, 1, 0, 0, 0),
        f"{folder}/Transform/{{0A9007C6-4076-11D3-8789-0000F8105754}}/InstanceData/ResetTable": struct.pack("<10I", 3, len(places), 8, 40, len(content), 0, sum(map(len, frames)), 0, FRAME, 0) + struct.pack(f"<{len(places)}Q", *places),
        **(more or {}),
    }
    store = b""
    for name, data in plain.items():
        entries.append((name, 0, len(store), len(data)))
        store += data

    def number(n):
        out = bytes((n & 0x7F,))
        while n := n >> 7:
            out = bytes((n & 0x7F | 0x80,)) + out
        return out

    size, sheets, room = 8192, [], 8192 - 48 - 2
    body, held = b"", 0
    for name, section, at, length in sorted(entries):
        row = number(len(name.encode())) + name.encode() + number(section) + number(at) + number(length)
        if len(body) + len(row) > room:
            sheets.append((body, held))
            body, held = b"", 0
        body, held = body + row, held + 1
    sheets.append((body, held))
    pages = b"".join(b"AOLL" + struct.pack("<i", size - 48 - len(b)) + bytes(40) + b + bytes(size - 50 - len(b)) + struct.pack("<H", n) for b, n in sheets)
    directory = b"IFCM" + struct.pack("<IiIiiiI", 1, size, 0x100000, -1, -1, len(sheets), 0) + pages
    pieces, second = 2, 4 * 4 + 48 + 32
    head = 40
    start = head + 16 * pieces + second
    base = start + len(directory)
    blocks = b"\0" * 4 + struct.pack("<i", 16) + bytes(8) + b"CAOL" + struct.pack("<Ii", 2, 48) + bytes(8) + struct.pack("<III", size, 0, 0x100000) + bytes(16)
    blocks += b"ITSF" + struct.pack("<IiII", 4, 32, 0, base)[:12] + struct.pack("<II", base, 0) + bytes(8)
    table = struct.pack("<IIiI", 0, 0, 0, 0) + struct.pack("<IIiI", start, 0, len(directory), 0)
    return b"ITOLITLS" + struct.pack("<Iiiii", 1, head, 0, pieces, len(blocks)) + bytes(head - 28) + table + blocks + directory + store
