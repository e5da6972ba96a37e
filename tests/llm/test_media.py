import hashlib
import struct
import zlib

import pytest
from codexa.llm.media import NotMedia, _store, feature, media_columns, op7_media, payload, read, write


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 200])
def test_round_trip(n):
    raw = bytes(i * 7 % 256 for i in range(576 * n))
    stored = write(raw)
    found = read(stored)
    track = found["tracks"][0]
    assert payload(stored, track) == raw and track["codec"] == "raw" and track["kind"] == "audio"
    assert track["duration"] == len(raw) and len(track["keyframes"]) == -(-n // 8)
    assert all(stored[a : a + s] == raw[8 * 576 * i : 8 * 576 * i + 576] for i, (a, s, _) in enumerate(track["keyframes"]))
    assert [t for _, _, t in track["keyframes"]] == [8 * 576 * i for i in range(-(-n // 8))]


def box(kind, *content):
    return struct.pack(">I4s", 8 + sum(map(len, content)), kind) + b"".join(content)


def test_other_layouts_are_read():
    """Varying sample sizes, several samples in a chunk, no sync table (all are keyframes), a 64-bit box, a size of 0."""
    samples = [b"aa", b"bbb", b"c", b"dddd"]
    data = b"".join(samples)
    front = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    stbl = box(
        b"stbl",
        box(b"stsd", bytes(4), struct.pack(">I", 1), box(b"avc1", bytes(8))),
        box(b"stsz", bytes(4), struct.pack(">6I", 0, 4, 2, 3, 1, 4)),
        box(b"stsc", bytes(4), struct.pack(">7I", 2, 1, 3, 1, 2, 1, 1)),
        box(b"co64", bytes(4), struct.pack(">IQQ", 2, 16, 22)),
    )
    mdia = box(b"mdia", box(b"mdhd", bytes(12), struct.pack(">III", 1000, 2500, 0)), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", stbl))
    movie = box(b"moov", box(b"mvhd", bytes(12), struct.pack(">II", 10, 25)), box(b"trak", mdia))
    whole = front + movie[:0] + struct.pack(">I4s", 0, b"moov") + movie[8:]
    found = read(whole)
    track = found["tracks"][0]
    assert found["seconds"] == 2.5 and track["kind"] == "video" and track["codec"] == "avc1" and track["duration"] == 2500
    assert payload(whole, track) == data and len(track["keyframes"]) == 4


@pytest.mark.parametrize("bad", [b"", b"xx", b"\0\0\0\x04moov", write(b"a" * 576)[:300], box(b"moov") + b"12"])
def test_broken_ones_are_told(bad):
    with pytest.raises(NotMedia):
        read(bad)


def test_columns(spark, corpus, rows):
    media = spark.createDataFrame([(1, write(b"a" * 576 * 20), "x"), (2, b"junk", "y"), (3, None, None)], "id int, content binary, brand string")
    got = {r.row.id: r for r in media_columns(media).collect()}
    assert got[1].brand == "qt" and got[1].error is None and len(got[1].tracks[0].keyframes) == 3
    assert got[2].brand is None and got[2].tracks == [] and got[3].error
    stored = corpus.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((str(i), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert sorted((str(r[0]), *r[1:5]) for r in stored) == sorted(want)


def full(kind, *content, flags=0):
    return box(kind, struct.pack(">I", flags), *content)


def movie(*tables, extra=b"", more=b"", number=1):
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), *tables)
    mdia = box(b"mdia", box(b"mdhd", bytes(12), struct.pack(">III", 1000, 0, 0)), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", stbl))
    return box(b"moov", box(b"mvhd", bytes(12), struct.pack(">II", 10, 0)), box(b"trak", full(b"tkhd", bytes(8), struct.pack(">I", number), bytes(68)), mdia), more, extra)


def test_times_come_from_the_time_tables():
    def made(at):
        return movie(
            full(b"stts", struct.pack(">5I", 2, 2, 40, 2, 10)), full(b"ctts", struct.pack(">IIiIi", 2, 1, 5, 3, 0)), full(b"stsz", struct.pack(">II4I", 0, 4, 1, 2, 3, 4)),
            full(b"stsc", struct.pack(">4I", 1, 1, 4, 1)), full(b"stco", struct.pack(">II", 1, at)), full(b"stss", struct.pack(">3I", 2, 1, 3)),
        )

    head = made(0)
    whole = made(len(head) + 8) + box(b"mdat", b"abbcccdddd")
    found = read(whole)
    track, base = found["tracks"][0], len(head) + 8
    assert track["keyframes"] == [(base, 1, 5), (base + 3, 3, 80)] and track["duration"] == 100 and found["seconds"] == 0.1
    assert feature(found).endswith(f"|4|{base}-{base + 1},{base + 3}-{base + 6}")


@pytest.mark.parametrize(("bits", "raw"), [(4, b"\x12\x30"), (8, b"\1\2\3"), (16, b"\0\1\0\2\0\3")])
def test_compact_sizes(bits, raw):
    tables = lambda at: (full(b"stz2", bytes(3), bytes([bits]), struct.pack(">I", 3), raw), full(b"stsc", struct.pack(">4I", 1, 1, 3, 1)), full(b"stco", struct.pack(">II", 1, at)))
    head = movie(*tables(0))
    track = read(movie(*tables(len(head) + 8)) + box(b"mdat", b"abbccc"))["tracks"][0]
    assert [s for _, s in track["ranges"]] == [1, 2, 3] and track["ranges"][2][0] == len(head) + 11
    with pytest.raises(NotMedia):
        read(movie(full(b"stz2", bytes(3), bytes([bits]), struct.pack(">I", 300), raw)))


@pytest.mark.parametrize("moof_is_base", [True, False])
def test_fragments_are_walked(moof_is_base):
    """Two fragments of one track: defaults of the movie, of the fragment, fields of each sample, a first sample's flags."""
    defaults = box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 20, 3, 0x10000)))
    front = box(b"ftyp", b"iso6", bytes(4)) + movie(full(b"stsz", struct.pack(">II", 0, 0)), full(b"stsc", struct.pack(">I", 0)), full(b"stco", struct.pack(">I", 0)), more=defaults, number=7)
    flag = 0x20000 if moof_is_base else 0

    def one(at):
        return box(
            b"moof", full(b"mfhd", struct.pack(">I", 1)),
            box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=flag), full(b"tfdt", struct.pack(">I", 500)), full(b"trun", struct.pack(">IiI", 3, at, 0), flags=0x5)),
        )

    def two(at):
        samples = struct.pack(">4I", 30, 2, 0, 5) + struct.pack(">4I", 10, 4, 0x10000, 0)
        run = full(b"trun", struct.pack(">Ii", 2, at), samples, flags=0xF01)
        after = full(b"trun", struct.pack(">I", 1))
        return box(b"moof", full(b"mfhd", struct.pack(">I", 2)), box(b"traf", full(b"tfhd", struct.pack(">III", 7, 9, 1), flags=flag | 0x18), run, after))

    a, b = len(one(0)), len(two(0))
    whole = front + one(a + 8) + box(b"mdat", b"aaabbbccc") + two(b + 8) + box(b"mdat", b"ddeeeef")
    track = read(whole)["tracks"][0]
    assert payload(whole, track) == b"aaabbbcccddeeeef" and track["n_samples"] == 6 and track["duration"] == 500 + 60 + 40 + 9
    first, second = len(front) + a + 8, len(front) + a + 17 + b + 8
    assert track["keyframes"] == [(first, 3, 500), (second, 2, 565)]
    with pytest.raises(NotMedia):
        read(front + one(a + 8))


def test_user_data_may_end_with_a_zero():
    plain = write(b"a" * 576)
    at = plain.index(b"moov") - 4
    size = struct.unpack_from(">I", plain, at)[0]
    user = box(b"udta", box(b"name", b"x"), bytes(4))
    grown = plain[:at] + struct.pack(">I", size + len(user)) + plain[at + 4 : at + size] + user + plain[at + size :]
    assert read(grown)["tracks"][0]["codec"] == "raw"
    with pytest.raises(NotMedia):
        read(plain[:at] + struct.pack(">I", size + 12) + plain[at + 4 : at + size] + box(b"udta", b"\0\0\0\1") + plain[at + size :])


def test_a_chunk_zero_is_no_chunk():
    with pytest.raises(NotMedia):
        read(movie(full(b"stsz", struct.pack(">II", 1, 1)), full(b"stsc", struct.pack(">4I", 1, 0, 1, 1)), full(b"stco", struct.pack(">II", 1, 0))))


def test_the_query_over_a_megabyte_and_over_nothing(spark, nothing, tmp_path):
    text = "zeile " * 200_000
    spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_media(spark, str(tmp_path)).collect()
    raw = text.encode() + b"\xff" * (-len(text) % 576)
    stored = write(raw)
    long = [r for r in got if r.doc_id == 1]
    assert len(got) == 3 and long[0] == long[1] and long[0].payload_sha256 == hashlib.sha256(raw).hexdigest() and long[0].media_sha256 == hashlib.sha256(stored).hexdigest()
    ranges = [tuple(map(int, x.split("-"))) for x in long[0].feature.split("|")[-1].split(",")]
    assert [stored[a:b] for a, b in ranges] == [raw[i : i + 576] for i in range(0, len(raw), 8 * 576)]
    nothing.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert op7_media(spark, f"{tmp_path}/empty").collect() == []
