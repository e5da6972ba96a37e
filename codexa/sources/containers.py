"""Containers and decompressors: ZIP, zlib, Palm databases, PalmDOC, HUFF/CDIC."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from codexa.sources.model import Corrupt, Options, OverLimit


class Zip:
    """A ZIP file in memory; reads stop at the limit."""

    def __init__(self, data: bytes, limit: int) -> None:
        try:
            self.file = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError) as e:
            raise Corrupt(f"zip: {e}") from e
        self.limit = limit
        self.names = [i.filename for i in self.file.infolist() if not i.is_dir()]
        self._by_name = {i.filename: i for i in reversed(self.file.infolist())}

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def size(self, name: str) -> int:
        return self._by_name[name].file_size

    def head(self, name: str, n: int) -> bytes:
        try:
            with self.file.open(self._by_name[name]) as f:
                return f.read(n)
        except (KeyError, zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError) as e:
            raise Corrupt(f"zip entry {name}: {e}") from e

    def read(self, name: str) -> bytes:
        data = self.head(name, self.limit + 1)
        if len(data) > self.limit:
            raise OverLimit(f"{name} is over {self.limit} bytes")
        return data


def is_zip(data: bytes) -> bool:
    return data[:4] == b"PK\x03\x04"


def inflate(data: bytes, limit: int) -> bytes:
    """zlib data of at most `limit` bytes."""
    try:
        engine = zlib.decompressobj()
        out = engine.decompress(data, limit + 1)
    except zlib.error as e:
        raise Corrupt(f"zlib: {e}") from e
    if len(out) > limit:
        raise OverLimit(f"zlib data is over {limit} bytes")
    if not engine.eof:
        raise Corrupt("zlib: cut off")
    return out


def palmdoc(data: bytes, limit: int) -> bytes:
    """PalmDOC text: literals, runs, a space before a letter, references back; broken references are skipped."""
    out, at, size = bytearray(), 0, len(data)
    while at < size:
        c = data[at]
        at += 1
        if 1 <= c <= 8:
            out += data[at : at + c]
            at += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif at < size:
            pair = (c << 8 | data[at]) & 0x3FFF
            at += 1
            back, n = pair >> 3, (pair & 7) + 3
            if back == 0:
                out += bytes(n)
            elif back <= len(out):
                for _ in range(n):
                    out.append(out[-back])
        if len(out) > limit:
            raise OverLimit(f"text is over {limit} bytes")
    return bytes(out)


class PalmDatabase:
    """Header and records of a Palm database; a record that begins beyond the end is empty."""

    def __init__(self, data: bytes, options: Options) -> None:
        if len(data) < 78:
            raise Corrupt("palm database: header is cut off")
        self.name = data[:32].partition(b"\0")[0]
        self.kind = data[60:68]
        self.created, self.modified = struct.unpack_from(">II", data, 36)
        (count,) = struct.unpack_from(">H", data, 76)
        if 78 + 8 * count > len(data):
            raise Corrupt("palm database: record table is cut off")
        starts = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(count)]
        if any(a > b for a, b in zip(starts, starts[1:], strict=False)):
            raise Corrupt("palm database: records run backwards")
        self._spans = list(zip(starts, [*starts[1:], len(data)], strict=True))
        self._data, self._limit = data, options.max_record

    def __len__(self) -> int:
        return len(self._spans)

    def __getitem__(self, i: int) -> bytes:
        if not 0 <= i < len(self._spans):
            raise Corrupt(f"palm database: no record {i}")
        a, b = self._spans[i]
        if b - a > self._limit:
            raise OverLimit(f"record {i} is over {self._limit} bytes")
        return self._data[a : max(a, b)]


class Huff:
    """HUFF/CDIC: canonical codes into a dictionary whose entries may be coded themselves."""

    DEPTH = 32

    def __init__(self, huff: bytes, cdics: list[bytes]) -> None:
        if huff[:8] != b"HUFF\0\0\0\x18" or len(huff) < 24:
            raise Corrupt("huff: bad header")
        first, second = struct.unpack_from(">II", huff, 8)
        if first + 1024 > len(huff) or second + 256 > len(huff):
            raise Corrupt("huff: tables are cut off")
        self.fast = []
        for v in struct.unpack_from(">256I", huff, first):
            size = v & 0x1F
            self.fast.append((size, bool(v & 0x80), (((v >> 8) + 1) << (32 - size)) - 1))
        pairs = struct.unpack_from(">64I", huff, second)
        self.low = [0, *(pairs[2 * i] << (31 - i) for i in range(32))]
        self.high = [0xFFFFFFFF, *(((pairs[2 * i + 1] + 1) << (31 - i)) - 1 for i in range(32))]
        self.entries: list[tuple[bytes | None, bool]] = []
        for record in cdics:
            if record[:8] != b"CDIC\0\0\0\x10" or len(record) < 16:
                raise Corrupt("cdic: bad header")
            total, bits = struct.unpack_from(">II", record, 8)
            count = min(1 << bits, total - len(self.entries)) if bits < 32 else total - len(self.entries)
            if count < 0 or 16 + 2 * count > len(record):
                raise Corrupt("cdic: table is cut off")
            for off in struct.unpack_from(f">{count}H", record, 16):
                if 18 + off > len(record):
                    raise Corrupt("cdic: entry out of range")
                (size,) = struct.unpack_from(">H", record, 16 + off)
                end = 18 + off + (size & 0x7FFF)
                if end > len(record):
                    raise Corrupt("cdic: entry out of range")
                self.entries.append((record[18 + off : end], bool(size & 0x8000)))

    def unpack(self, data: bytes, limit: int, depth: int = 0) -> bytes:
        if depth > self.DEPTH:
            raise Corrupt("huff: too deep")
        bits, at, total = int.from_bytes(data + bytes(8), "big"), 0, 8 * len(data)
        width = total + 64
        out = bytearray()
        while True:
            if at + 32 > width:
                raise Corrupt("huff: out of bits")
            code = bits >> (width - at - 32) & 0xFFFFFFFF
            size, final, top = self.fast[code >> 24]
            if not final:
                while code < self.low[size]:
                    size += 1
                    if size > 32:
                        raise Corrupt("huff: no such code")
                top = self.high[size]
            at += size
            if at > total:
                return bytes(out)
            if not size:
                raise Corrupt("huff: empty code")
            number = (top - code) >> (32 - size)
            if not 0 <= number < len(self.entries):
                raise Corrupt("huff: no such entry")
            value, plain = self.entries[number]
            if not plain:
                self.entries[number] = (b"", True)
                value = self.unpack(value, limit - len(out), depth + 1)
                self.entries[number] = (value, True)
            out += value
            if len(out) > limit:
                raise OverLimit(f"text is over {limit} bytes")
