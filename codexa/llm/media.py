"""ISO base media containers: boxes, sample tables, keyframe byte ranges.

The reader walks nested boxes and decodes the sample tables, and the runs of
fragments, into the place, size, time and kind of every sample; it never decodes a
payload. The writer stores bytes losslessly as constant-size samples of a single
uncompressed 8-bit track, so that any bytes can be carried and read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import as_bytes, bounded, part, pieces

# Box types that hold boxes.
NESTED = (b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"moof", b"traf", b"mvex", b"udta")
# Bits of the flags of track fragment headers and runs, and of a sample's own flags.
BASE, DESCRIBED, DURATION, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
RUN_AT, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
MOOF_IS_BASE, NOT_SYNC = 0x20000, 0x10000
# Handler types of tracks.
HANDLERS = {"vide": "video", "soun": "audio", "hint": "hint", "meta": "metadata", "text": "text", "subt": "subtitle"}

SAMPLE = 576
RATE = 44_100
#: Samples of a chunk, and of a keyframe interval.
PER_CHUNK, GROUP = 16, 8


class NotMedia(ValueError):
    """The bytes are no container that can be read."""


def boxes(data: memoryview, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin of content, end) of each box; a size of 0 runs to the end, 1 has a 64-bit size."""
    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > stop:
                raise NotMedia("a 64-bit size is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise NotMedia(f"box {kind!r} at {start} does not fit")
        yield kind, start + head, start + size
        start += size
    if start != stop and not (stop - start == 4 and not any(data[start:stop])):  # a list of user data may end with a 32-bit zero
        raise NotMedia("bytes are left after the last box")


def tree(data: memoryview, start: int, stop: int) -> list[tuple[bytes, int, int, list]]:
    """Boxes with the boxes inside, depth limited by the data's size alone (a worklist, no recursion)."""
    top: list = []
    work = [(start, stop, top)]
    while work:
        a, b, into = work.pop()
        for kind, begin, end in boxes(data, a, b):
            inner: list = []
            into.append((kind, begin, end, inner))
            if kind in NESTED:
                work.append((begin, end, inner))
    return top


def find(nodes: list, *path: bytes) -> list:
    """All boxes at a path of types."""
    for i, kind in enumerate(path):
        nodes = [n for n in nodes if n[0] == kind]
        if i + 1 < len(path):
            nodes = [x for n in nodes for x in n[3]]
    return nodes


def _table(data: memoryview, nodes: list, kind: bytes, row: str, head: int = 4) -> list[tuple]:
    """Rows of a table box: version and flags, `head` bytes before the count ends, count, rows."""
    found = find(nodes, kind)
    if not found:
        return []
    _, begin, end, _ = found[0]
    count = struct.unpack_from(">I", data, begin + head)[0]
    size = struct.calcsize(row)
    if begin + head + 4 + count * size > end:
        raise NotMedia(f"table {kind!r} is cut off")
    return list(struct.iter_unpack(row, data[begin + head + 4 : begin + head + 4 + count * size]))


def _timed(data: memoryview, node) -> tuple[int, int]:
    """Time scale and duration of a header box, 32 or 64 bits wide."""
    begin = node[1]
    return struct.unpack_from(">IQ", data, begin + 20) if data[begin] == 1 else struct.unpack_from(">II", data, begin + 12)


def _sizes(data: memoryview, table: list) -> list[int]:
    """Size of each sample, from either kind of table."""
    if found := find(table, b"stsz"):
        fixed, count = struct.unpack_from(">II", data, found[0][1] + 4)
        if not fixed:
            return [x for (x,) in _table(data, table, b"stsz", ">I", head=8)]
        if count * fixed > len(data):
            raise NotMedia("samples are larger than the file")
        return [fixed] * count
    if found := find(table, b"stz2"):
        begin, end = found[0][1:3]
        bits, count = data[begin + 7], struct.unpack_from(">I", data, begin + 8)[0]
        if bits not in (4, 8, 16) or begin + 12 + (count * bits + 7) // 8 > end:
            raise NotMedia("the compact sample sizes cannot be read")
        raw = data[begin + 12 : begin + 12 + (count * bits + 7) // 8]
        if bits == 16:
            return [x for (x,) in struct.iter_unpack(">H", raw)]
        return list(raw) if bits == 8 else [x for b in raw for x in (b >> 4, b & 15)][:count]
    return []


def _spread(rows: list[tuple[int, int]], count: int) -> list[int]:
    """A run-length table as one value for each of `count` samples; 0 where the table ends."""
    out: list[int] = []
    for n, value in rows:
        out += [value] * min(n, count - len(out))
    return out + [0] * (count - len(out))


def _offsets(data: memoryview, table: list, sizes: list[int]) -> list[int]:
    """Place of each sample that a chunk holds."""
    chunks = [x for (x,) in (_table(data, table, b"co64", ">Q") or _table(data, table, b"stco", ">I"))]
    per = _table(data, table, b"stsc", ">III")
    if any(b[0] <= a[0] for a, b in zip([(0,), *per], per, strict=False)):
        raise NotMedia("the first chunks do not rise from 1")
    offsets, sample = [], 0
    for i, (first, count, _) in enumerate(per):
        last = per[i + 1][0] - 1 if i + 1 < len(per) else len(chunks)
        for chunk in range(first - 1, min(last, len(chunks))):
            at = chunks[chunk]
            for _ in range(min(count, len(sizes) - sample)):
                offsets.append(at)
                at += sizes[sample]
                sample += 1
    return offsets


def _track(data: memoryview, trak) -> dict:
    media = find(trak[3], b"mdia")
    inner = media[0][3] if media else []
    table = (find(inner, b"minf", b"stbl") or [(b"", 0, 0, [])])[0][3]
    head = find(trak[3], b"tkhd")
    number = struct.unpack_from(">I", data, head[0][1] + (20 if data[head[0][1]] == 1 else 12))[0] if head else 0
    scale, duration = _timed(data, find(inner, b"mdhd")[0]) if find(inner, b"mdhd") else (0, 0)
    handler = bytes(data[(h := find(inner, b"hdlr")[0][1]) + 8 : h + 12]).decode("latin-1") if find(inner, b"hdlr") else ""
    described = find(table, b"stsd")
    codec = bytes(data[described[0][1] + 12 : described[0][1] + 16]).decode("latin-1").strip() if described and described[0][2] >= described[0][1] + 16 else ""
    sizes = _sizes(data, table)
    sync = {x for (x,) in _table(data, table, b"stss", ">I")} if find(table, b"stss") else None
    offsets = _offsets(data, table, sizes)
    lasts = _spread(_table(data, table, b"stts", ">II"), len(sizes))
    shifts = _spread(_table(data, table, b"ctts", ">Ii"), len(sizes))
    samples, now = [], 0
    for n, (at, size, last, shift) in enumerate(zip(offsets, sizes, lasts, shifts, strict=False), 1):
        samples.append((at, size, now + shift, sync is None or n in sync))
        now += last
    return {"id": number, "kind": HANDLERS.get(handler, handler), "codec": codec, "timescale": scale, "duration": duration, "samples": samples, "end": now, "count": len(sizes)}


def _fragments(data: memoryview, top: list, tracks: list[dict]) -> None:
    """Add the samples of the movie's fragments to their tracks."""
    by_id = {t["id"]: t for t in tracks}
    defaults = {}
    for _, begin, _, _ in find(top, b"moov", b"mvex", b"trex"):
        number, _, *rest = struct.unpack_from(">5I", data, begin + 4)
        defaults[number] = rest
    for moof in find(top, b"moof"):
        follow = None  # where the last fragment's data ended
        for traf in find(moof[3], b"traf"):
            heads = find(traf[3], b"tfhd")
            if not heads:
                raise NotMedia("a fragment without a header")
            at = heads[0][1]
            flags, number = struct.unpack_from(">II", data, at)
            flags, at = flags & 0xFFFFFF, at + 8
            track = by_id.get(number)
            if track is None:
                raise NotMedia(f"a fragment of no track: {number}")
            base = None
            if flags & BASE:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 if flags & DESCRIBED else 0
            own = list(defaults.get(number, (0, 0, 0)))
            for i, bit in enumerate((DURATION, SIZE, FLAGS)):
                if flags & bit:
                    own[i], at = struct.unpack_from(">I", data, at)[0], at + 4
            if base is None:  # the box itself, of which the content begins after 8 bytes
                base = moof[1] - 8 if flags & MOOF_IS_BASE or follow is None else follow
            if times := find(traf[3], b"tfdt"):
                begin = times[0][1]
                track["end"] = struct.unpack_from(">Q" if data[begin] == 1 else ">I", data, begin + 4)[0]
            ended = None  # the place after this fragment's last run
            for _, begin, _, _ in find(traf[3], b"trun"):
                kind, count = struct.unpack_from(">II", data, begin)
                version, kind, at = kind >> 24, kind & 0xFFFFFF, begin + 8
                place = base if ended is None else ended
                if kind & RUN_AT:
                    place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
                first = None
                if kind & RUN_FIRST:
                    first, at = struct.unpack_from(">I", data, at)[0], at + 4
                fields = [b for b in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if kind & b]
                if count > len(data) or at + 4 * count * len(fields) > len(data):
                    raise NotMedia("a run is cut off")
                for n in range(count):
                    has = {}
                    for bit in fields:
                        has[bit], at = struct.unpack_from(">i" if bit == RUN_SHIFT and version else ">I", data, at)[0], at + 4
                    size = has.get(RUN_SIZE, own[1])
                    mark = has.get(RUN_FLAGS, first if n == 0 and first is not None else own[2])
                    if place < 0 or place + size > len(data):
                        raise NotMedia("a sample lies outside the file")
                    track["samples"].append((place, size, track["end"] + has.get(RUN_SHIFT, 0), not mark & NOT_SYNC))
                    track["end"] += has.get(RUN_DURATION, own[0])
                    track["count"] += 1
                    place += size
                follow = ended = place


def read(content: bytes) -> dict:
    """Brand, seconds and tracks of a container; NotMedia if it is none.

    A track: kind, codec, timescale, duration, n_samples, ranges (offset, size) of all samples in the order of
    the file's tables, keyframes (offset, size, time), times in units of the timescale.
    """
    data = memoryview(content)
    try:
        top = tree(data, 0, len(data))
        if not find(top, b"moov"):
            raise NotMedia("no movie box")
        brand = bytes(data[(b := find(top, b"ftyp")[0][1]) : b + 4]).decode("latin-1").strip() if find(top, b"ftyp") else ""
        scale, duration = _timed(data, find(top, b"moov", b"mvhd")[0]) if find(top, b"moov", b"mvhd") else (0, 0)
        tracks = [_track(data, t) for t in find(top, b"moov", b"trak")]
        _fragments(data, top, tracks)
    except (struct.error, IndexError) as e:
        raise NotMedia(str(e)) from e
    out = []
    for t in tracks:
        samples = t["samples"]
        if any(a + s > len(data) for a, s, _, _ in samples):
            raise NotMedia("a sample lies outside the file")
        out.append(
            {
                "kind": t["kind"], "codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"] or t["end"], "n_samples": t["count"],
                "ranges": [(a, s) for a, s, _, _ in samples], "keyframes": [(a, s, time) for a, s, time, key in samples if key],
            }
        )
    seconds = duration / scale if scale and duration else max((t["duration"] / t["timescale"] for t in out if t["timescale"]), default=0.0)
    return {"brand": brand, "seconds": seconds, "tracks": out}


def payload(content: bytes, track: dict) -> bytes:
    """A track's samples in order; neighbouring ones are copied at once."""
    out, data = [], memoryview(content)
    begin = end = 0
    for at, size in track["ranges"]:
        if at != end:
            out.append(data[begin:end])
            begin = at
        end = at + size
    out.append(data[begin:end])
    return b"".join(out)


def _box(kind: bytes, *content: bytes) -> bytes:
    size = 8 + sum(map(len, content))
    return struct.pack(">I4s", size, kind) + b"".join(content)


def _full(kind: bytes, *content: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *content)


def write(raw: bytes, sample: int = SAMPLE, rate: int = RATE) -> bytes:
    """Bytes, a multiple of `sample`, as one track of unsigned 8-bit mono audio, `sample` bytes a sample."""
    count, rest = divmod(len(raw), sample)
    if rest or not count:
        raise ValueError(f"not a positive multiple of {sample} bytes")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks = -(-count // PER_CHUNK)
    wide = len(raw) > 0xF0000000
    sync = range(1, count + 1, GROUP)

    def movie(base: int) -> bytes:
        last = count - (chunks - 1) * PER_CHUNK
        per = [(1, PER_CHUNK, 1), (chunks, last, 1)] if chunks > 1 and last != PER_CHUNK else [(1, min(count, PER_CHUNK), 1)]
        places = [base + i * PER_CHUNK * sample for i in range(chunks)]
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))),
            _full(b"stts", struct.pack(">III", 1, count, sample)),
            _full(b"stsc", struct.pack(">I", len(per)), *(struct.pack(">III", *p) for p in per)),
            _full(b"stsz", struct.pack(">II", sample, count)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *places)),
            _full(b"stss", struct.pack(">I", len(sync)), struct.pack(f">{len(sync)}I", *sync)),
        )
        length = struct.pack(">Q", count * sample)
        media = _box(
            b"mdia",
            _box(b"mdhd", b"\1\0\0\0", bytes(16), struct.pack(">I", rate), length, b"\x55\xc4\0\0"),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), table),
        )
        track = _box(b"trak", _box(b"tkhd", b"\1\0\0\7", bytes(16), struct.pack(">II", 1, 0), length, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8)), media)
        head = _box(b"mvhd", b"\1\0\0\0", bytes(16), struct.pack(">I", rate), length, struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", head, track)

    brand = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    front = struct.pack(">I4sQ", 1, b"mdat", 16 + len(raw)) if wide else struct.pack(">I4s", 8 + len(raw), b"mdat")
    base = len(brand) + len(movie(0)) + len(front)
    return brand + movie(base) + front + raw


TRACK = "struct<kind:string,codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<offset:long,size:long,time:long>>>"


def _describe(batches: Iterator[pa.RecordBatch], content: str) -> Iterator[pa.RecordBatch]:
    track = pa.struct(
        [("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()),
         ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time", pa.int64())])))]
    )
    for batch in pieces(batches, content):
        brands, seconds, tracks, errors = [], [], [], []
        for data in batch.column(content).to_pylist():
            try:
                found = read(data or b"")
                errors.append(None)
            except NotMedia as e:
                found = {"brand": None, "seconds": None, "tracks": []}
                errors.append(str(e))
            brands.append(found["brand"])
            seconds.append(found["seconds"])
            tracks.append([{**t, "keyframes": [{"offset": a, "size": s, "time": x} for a, s, x in t["keyframes"]]} for t in found["tracks"]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(brands, pa.string()), pa.array(seconds, pa.float64()), pa.array(tracks, pa.list_(track)), pa.array(errors, pa.string())],
            ["row", "brand", "seconds", "tracks", "error"],
        )


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """(row, brand, seconds, tracks, error) for a table with a binary column; row is the input row without it.

    A null, empty or broken container gives null columns, no tracks and what is wrong; it fails nothing.
    """
    rest = [c for c in df.columns if c != content]
    rows = df.select(F.struct(*rest).alias("row"), F.col(content).alias("content"))
    return rows.mapInArrow(part(_describe, content="content"), f"row {dict(rows.dtypes)['row']}, brand string, seconds double, tracks array<{TRACK}>, error string")


def feature(found: dict) -> str:
    """Brand, kind, codec, time scale, duration and number of samples of a container's first track, then every keyframe's byte range, begin-end."""
    t = found["tracks"][0]
    ranges = ",".join(f"{a}-{a + s}" for a, s, _ in t["keyframes"])
    return f"{found['brand']}|{t['kind']}|{t['codec']}|{t['timescale']}|{t['duration']}|{t['n_samples']}|{ranges}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the digests of the padded text, read back from its container, and of the container; null counts as empty."""
    for batch in pieces(batches, "text"):
        rows = []
        for text in as_bytes(batch.column("text")):
            stored = write(text + b"\xff" * (-len(text) % SAMPLE if text else SAMPLE))
            found = read(stored)
            back = payload(stored, found["tracks"][0])
            rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(found)))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored in a container and read back.

    One row for each row of the table, repeated rows and null ids included; a null text counts as empty and
    is stored as one sample of padding. No rows give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bounded(docs).mapInArrow(
        _store, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
