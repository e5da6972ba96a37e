"""LZX: a window, Huffman-coded blocks, and the undoing of x86 call translation."""

from __future__ import annotations

from codexa.sources.model import Corrupt

FRAME = 0x8000
MIN_MATCH, LENGTHS, PRIMARY = 2, 249, 7


class _Bits:
    """16-bit little-endian units, the upper bits first; two bytes of zeros may follow the end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            if self.at > len(self.data) + 2:
                raise Corrupt("lzx: cut off")
            self.held = self.held << 16 | int.from_bytes(self.data[self.at : self.at + 2].ljust(2, b"\0"), "little")
            self.at += 2
            self.count += 16

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.count -= n
        value = self.held >> self.count & (1 << n) - 1
        self.held &= (1 << self.count) - 1
        return value

    def align(self) -> None:
        """On to the next 16-bit unit."""
        drop = self.count % 16
        self.take(drop)

    def raw(self, n: int) -> bytes:
        """Whole bytes, after align()."""
        self.at -= self.count // 8
        self.held = self.count = 0
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise Corrupt("lzx: cut off")
        self.at += n
        return out


class _Tree:
    """A canonical code by a table over `width` bits; longer codes by search."""

    def __init__(self, lengths: list[int]) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        code = 0
        self.longest = max(lengths, default=0)
        for size in range(1, self.longest + 1):
            for symbol, n in enumerate(lengths):
                if n == size:
                    self.codes[size, code] = symbol
                    code += 1
            code <<= 1
        if self.longest and code >> 1 > 1 << self.longest:
            raise Corrupt("lzx: code has too many symbols")
        self.width = min(self.longest, 9)
        self.fast: list[tuple[int, int] | None] = [None] * (1 << self.width)
        for (size, c), symbol in self.codes.items():
            if size <= self.width:
                low = c << (self.width - size)
                self.fast[low : low + (1 << (self.width - size))] = [(size, symbol)] * (1 << (self.width - size))

    def read(self, bits: _Bits) -> int:
        if not self.longest:
            raise Corrupt("lzx: empty code")
        bits.need(self.longest)
        found = self.fast[bits.held >> (bits.count - self.width) & (1 << self.width) - 1]
        if found is None:
            for size in range(self.width + 1, self.longest + 1):
                symbol = self.codes.get((size, bits.held >> (bits.count - size) & (1 << size) - 1))
                if symbol is not None:
                    found = (size, symbol)
                    break
            else:
                raise Corrupt("lzx: no such code")
        bits.take(found[0])
        return found[1]


def _slots(window: int) -> int:
    """Position slots of a window: two for each power of two up to 2**18, then one for each 2**17."""
    return 2 * window if window <= 19 else {20: 42, 21: 50}[window]


def _footer(slot: int) -> int:
    return 0 if slot < 4 else min(17, slot // 2 - 1)


def _bases(count: int) -> list[int]:
    out, base = [], 0
    for slot in range(count):
        out.append(base)
        base += 1 << _footer(slot)
    return out


def _lengths(bits: _Bits, lengths: list[int], begin: int, end: int) -> None:
    """Code lengths as differences, themselves coded by a small tree."""
    small = _Tree([bits.take(4) for _ in range(20)])
    at = begin
    while at < end:
        symbol = small.read(bits)
        if symbol == 17 or symbol == 18:
            n = 4 + bits.take(4) if symbol == 17 else 20 + bits.take(5)
            value = 0
        elif symbol == 19:
            n = 4 + bits.take(1)
            value = (lengths[at] - small.read(bits)) % 17
        else:
            n, value = 1, (lengths[at] - symbol) % 17
        for i in range(at, min(at + n, end)):
            lengths[i] = value
        at += n


def _untranslate(frame: bytearray, place: int, size: int) -> None:
    """Absolute targets of call instructions back to relative ones."""
    i = 0
    while (i := frame.find(0xE8, i, len(frame) - 10)) >= 0:
        target = int.from_bytes(frame[i + 1 : i + 5], "little", signed=True)
        here = place + i
        if -here <= target < size:
            frame[i + 1 : i + 5] = (target - here if target >= 0 else target + size).to_bytes(4, "little", signed=True)
        i += 5


def decompress(data: bytes, window: int, expected: int) -> bytes:
    """`expected` bytes of one LZX stream with a window of 2**window bytes."""
    if not 15 <= window <= 21:
        raise Corrupt("lzx: bad window")
    bits, out, span = _Bits(data), bytearray(), 1 << window
    slots = _slots(window)
    bases, footers = _bases(slots), [_footer(s) for s in range(slots)]
    main_lengths, length_lengths = [0] * (256 + 8 * slots), [0] * LENGTHS
    recent = [1, 1, 1]
    translated = bits.take(16) << 16 | bits.take(16) if bits.take(1) else 0
    main = length = aligned = None
    kind = left = odd = empty = 0
    while len(out) < expected:
        stop = min(expected, len(out) + FRAME - len(out) % FRAME)
        while len(out) < stop:
            if not left:
                if kind == 3 and odd:
                    bits.raw(1)
                kind, left = bits.take(3), bits.take(24)
                empty = 0 if left else empty + 1
                if empty > 16:
                    raise Corrupt("lzx: empty blocks")
                if kind == 2:
                    aligned = _Tree([bits.take(3) for _ in range(8)])
                if kind in (1, 2):
                    _lengths(bits, main_lengths, 0, 256)
                    _lengths(bits, main_lengths, 256, len(main_lengths))
                    main = _Tree(main_lengths)
                    _lengths(bits, length_lengths, 0, LENGTHS)
                    length = _Tree(length_lengths)
                elif kind == 3:
                    odd = left & 1
                    bits.take(16 if not bits.count % 16 else bits.count % 16)
                    raw = bits.raw(12)
                    recent = [int.from_bytes(raw[i : i + 4], "little") for i in (0, 4, 8)]
                else:
                    raise Corrupt("lzx: bad block")
                continue
            if kind == 3:
                n = min(left, stop - len(out))
                out += bits.raw(n)
                left -= n
                continue
            symbol = main.read(bits)
            if symbol < 256:
                out.append(symbol)
                left -= 1
                continue
            slot, size = (symbol - 256) >> 3, (symbol - 256) & 7
            size = size + MIN_MATCH if size < PRIMARY else PRIMARY + MIN_MATCH + length.read(bits)
            if slot < 3:
                distance = recent[slot]
                recent[slot], recent[0] = recent[0], distance
            else:
                extra = footers[slot]
                if kind == 2 and extra >= 3:
                    distance = bases[slot] - 2 + (bits.take(extra - 3) << 3) + aligned.read(bits)
                else:
                    distance = bases[slot] - 2 + bits.take(extra)
                recent = [distance, recent[0], recent[1]]
            if distance > len(out) or distance > span or distance <= 0 or size > left:
                raise Corrupt("lzx: bad reference")
            left -= size
            start = len(out) - distance
            if distance >= size:
                out += out[start : start + size]
            else:
                out += (bytes(out[start:]) * (size // distance + 1))[:size]
        if kind != 3 and stop % FRAME == 0:
            bits.align()
    result = bytearray(out[:expected])
    if translated:
        for place in range(0, min(len(result), FRAME * FRAME), FRAME):
            frame = result[place : place + FRAME]
            if len(frame) > 10:
                _untranslate(frame, place, translated)
                result[place : place + FRAME] = frame
    return bytes(result)
