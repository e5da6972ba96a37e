import random
import struct

import builders as b
import pytest
from pyspark.sql import functions as F
from codexa.sources import reader
from codexa.sources.containers import Huff, inflate, palmdoc
from codexa.sources.detect import detect, sniff
from codexa.sources.lzx import decompress
from codexa.sources.model import BookError, Corrupt, Options, OverLimit, Protected, Unsupported, clean_href, split_identifier
from codexa.sources.reader import parse

BOOKS = {"epub": b.epub(), "fb2": b.FB2.encode(), "fb2zip": b.zipped({"x.fb2": b.FB2}), "fb3": b.fb3(), "mobi": b.mobi6(language=0x409), "kf8": b.kf8(), "joint": b.joint(), "palmdoc": b.palmdoc(), "ereader": b.ereader(), "lrf": b.lrf(), "chm": b.chm(), "lit": b.lit()}


def test_detection():
    assert [detect(x) for x in BOOKS.values()] == ["epub", "fb2", "fb2", "fb3", "mobi", "mobi", "mobi", "mobi", "ereader", "lrf", "chm", "lit"]
    assert detect(b"") is None and detect(b"PK\x03\x04") is None and detect(b"ITOLITLS" + bytes(40)) == "lit"


def test_epub():
    book = parse(BOOKS["epub"])
    assert (book.file_type, book.version, book.title, book.authors) == ("epub", "3.0", "A & B", ["Ann", "Bob, X"])
    assert book.subjects == ["x", "y", "x"] and book.languages == ["en"] and book.publication_date == "1999" and (book.series, book.series_index) == ("Saga", "2")
    assert book.identifiers == [("ISBN", "9780306406157"), ("calibre", "77"), ("ISBN", "0306406152")]
    assert [r.id for r in book.resources] == ["c1", "c2", "img"] and book.cover.id == "img" and book.resources[0].charset == "windows-1251"
    assert [(r.id, linear) for r, linear in book.order] == [("c1", True), ("c2", False), ("c1", True)]


@pytest.mark.parametrize(
    ("more", "error"),
    [
        ({"META-INF/encryption.xml": '<e><EncryptionMethod Algorithm="http://www.w3.org/2001/04/xmlenc#aes128-cbc"/></e>'}, Protected),
        ({"META-INF/encryption.xml": "broken <"}, Protected),
        ({"META-INF/encryption.xml": '<e><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/></e>'}, None),
        ({"META-INF/encryption.xml": ""}, None),
        ({"META-INF/rights.xml": "x", "OEBPS/c1.xhtml": b"\1\2\3"}, Protected),
        ({"META-INF/rights.xml": "x"}, None),
        ({"OEBPS/a.opf": "<package"}, Corrupt),
    ],
)
def test_epub_protection(more, error):
    if error is None:
        assert parse(b.epub(**more)).title
    else:
        with pytest.raises(error):
            parse(b.epub(**more))


def test_fictionbook():
    for name in ("fb2", "fb2zip"):
        book = parse(BOOKS[name])
        assert (book.version, book.title, book.authors, book.description) == ("2.0", "Title & more", ["Ann Lee"], "One.\n\nTwo.")
        assert book.subjects == ["sf", "a", "b"] and book.publication_date == "1990" and (book.series, book.series_index) == ("S", "3")
        assert book.identifiers == [("UUID", "1-2"), ("ISBN", "0306406152")] and book.cover.name == "c.png"
        assert [(r.name, linear) for r, linear in book.order] == [("body.xml", True), ("body1.xml", False)]
        assert [r.name for r in book.resources] == ["body.xml", "body1.xml", "c.png", "c-2.png"]
    book = parse(BOOKS["fb3"])
    assert (book.title, book.authors, book.subjects, book.languages, book.publisher) == ("Main title", ["A B"], ["x"], ["ru"], "P")
    assert book.identifiers == [("UUID", "u-1"), ("ISBN", "0306406152")] and [r.id for r in book.resources] == ["body", "i"] and book.cover.id == "i"


def test_palm_books():
    book = parse(BOOKS["mobi"])
    assert (book.version, book.title, book.authors, book.subjects, book.languages) == ("6", "New title", ["Ann"], ["x", "y"], ["en-US"])
    assert book.identifiers == [("ISBN", "0306406152"), ("ASIN", "B00")] and book.cover.media_type == "image/png"
    assert book.resources[0].content == b"<html><body><p>One two</p></body></html>"
    assert parse(BOOKS["kf8"]).resources[0].content == b"<html><body><p>inside</p></body></html>"
    both = parse(BOOKS["joint"])
    assert (both.version, both.title, both.resources[0].content) == ("6/8", "Eight", b"<p>new</p>")
    assert parse(b.joint(broken=True)).resources[0].content == b"<p>old</p>"
    with pytest.raises(BookError):
        parse(b.joint(broken=True), Options(mobi6_fallback=False))
    with pytest.raises(Protected):
        parse(b.mobi6(drm=5))
    plain = parse(BOOKS["palmdoc"])
    assert (plain.file_type, plain.title) == ("palmdoc", "Name") and plain.resources[0].media_type == "text/plain"
    ere = parse(BOOKS["ereader"])
    assert (ere.title, ere.authors, ere.publisher, ere.version) == ("Title", ["Author"], "Pub", "132") and ere.cover.name == "cover.png"
    with pytest.raises(Protected):
        parse(b.ereader(260))


def test_lrf_and_help():
    book = parse(BOOKS["lrf"])
    assert (book.title, book.authors, book.subjects, book.languages, book.version) == ("T", ["A", "B & C"], ["x", "y"], ["en"], "999")
    assert book.resources[0].content.decode("utf-16-le") == "\n\nHi￼ x\ny" and book.cover.id == "cover" and book.resources[1].content == b.PNG
    help_ = parse(BOOKS["chm"])
    assert (help_.title, help_.authors, help_.languages, help_.version) == ("Help", ["A", "B"], ["en"], "3")
    assert [r.name for r, _ in help_.order] == ["b.htm", "a.htm"]
    bare = parse(b.chm({"/a.htm": b"<p>One</p>", "/b.htm": b"<p>Two</p>"}))
    assert [r.name for r, _ in bare.order] == ["b.htm", "a.htm"] and bare.title == "First"


def test_decoders():
    assert palmdoc(b"\x03abcd\xc1\x00", 99) == b"abcd A\0"
    assert palmdoc(bytes([0x61, 0x62, 0x80, 0x10]), 99) == b"ab" + b"abab"[:3]
    with pytest.raises(OverLimit):
        palmdoc(b"abc", 2)
    with pytest.raises(Corrupt):
        inflate(b"junk", 9)
    data = bytes(random.Random(0).choices(range(256), k=5000))
    assert decompress(b.lzx_literals(data), 15, len(data)) == data
    assert decompress(b.lzx_plain(data[:4999]), 15, 4999) == data[:4999]
    with pytest.raises(Corrupt):
        decompress(b"\0" * 40, 15, 100)


def test_huffman():
    """256 one-byte codes, each an entry of its own; entry 1 is coded by the codes of two others."""
    fast = b"".join(struct.pack(">I", 255 << 8 | 0x80 | 8) for _ in range(256))
    huff = b"HUFF\0\0\0\x18" + struct.pack(">II", 24, 24 + 1024) + bytes(8) + fast + bytes(256)
    entries = [bytes([65 + i % 26]) for i in range(256)]
    entries[1] = bytes([255 - 2, 255 - 3])
    offsets, body = [], b""
    for i, e in enumerate(entries):
        offsets.append(512 + len(body))
        body += struct.pack(">H", len(e) | (0 if i == 1 else 0x8000)) + e
    cdic = b"CDIC\0\0\0\x10" + struct.pack(">II", 256, 8) + struct.pack(">256H", *offsets) + body
    assert Huff(huff, [cdic]).unpack(bytes([255, 255 - 1, 255 - 4]), 99) == b"ACDE"
    with pytest.raises(Corrupt):
        Huff(b"HUFF", [])


def test_random_damage_never_escapes():
    draw = random.Random(5)
    for data in BOOKS.values():
        for _ in range(60):
            bad = bytearray(data)
            for _ in range(draw.randrange(1, 20)):
                bad[draw.randrange(len(bad))] = draw.randrange(256)
            try:
                parse(bytes(bad[: draw.choice([len(bad), draw.randrange(len(bad))])]))
            except BookError:
                pass


def test_small_rules():
    assert [clean_href(h) for h in ("a/b/../c?x#y", "/../x//y/.", "", "../a", "//a")] == ["a/c", "/x/y", ".", "../a", "/a"]
    assert split_identifier("isbn:1", "ISBN-13") == ("ISBN", "1") and split_identifier("urn:uuid:a") == ("UUID", "a") and split_identifier("http://x") == ("URL", "http://x")
    assert split_identifier("doi:1", "uuid") == ("UUID", "doi:1") and split_identifier(" ") == ("", "") and split_identifier("plain") == ("", "plain")
    with pytest.raises(Unsupported):
        parse(b"nothing")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    for name, data in {**BOOKS, "junk": b"junk", "drm": b.mobi6(drm=5)}.items():
        (path / name).write_bytes(data)
    return str(path)


def test_tables(spark, folder):
    parsed = reader.read_books(spark, folder).cache()
    rows = {r.path.rpartition("/")[2]: r for r in reader.books(parsed).collect()}
    assert len(rows) == 14 and rows["junk"].error_code == "UNSUPPORTED_FORMAT" and rows["drm"].error_code == "DRM" and rows["epub"].cover_pos == 2
    texts = {r.book_id.rpartition("/")[2]: r.text for r in reader.book_texts(parsed).collect()}
    assert texts["epub"] == "Привет\nПривет" and texts["fb2"].startswith("T\n\nHello") and texts["fb3"] == "One\nTwo" and texts["ereader"] == "Chapter\n\n Hi"
    assert texts["lrf"] == "\n\nHi x\ny" and texts["chm"] == "Two\nOne" and texts["mobi"] == "One two" and texts["kf8"] == "inside"
    assert reader.resources(parsed).where("media_type like 'image/%'").count() >= 8
    assert {r.s for r in spark.read.format("binaryFile").load(folder).select(sniff(F.col("content")).alias("s")).collect()} >= {"zip", "mobi", "lrf", "chm", "fb2", "ereader", None}
    bare = reader.read_books(spark, folder, with_content=False)
    assert reader.resources(bare).where("content is not null").count() == 0
    small = reader.read_books(spark, folder, max_resource=10)
    assert "LIMIT_EXCEEDED" in {r.error_code for r in reader.resources(small).collect()} | {r.error_code for r in reader.books(small).collect()}


def test_data_source_and_stream(spark, folder, tmp_path):
    from codexa.sources import datasource
    from codexa.streaming.ingest import ingest, stream_books

    datasource.register(spark)
    assert spark.read.format("ebook").option("path", folder).load().where("error_code is null").count() == 12
    assert spark.read.format("ebook").option("path", f"file://{folder}/epub").load().first().title == "A & B"
    small = datasource.EbookReader({"path": folder})
    assert len(small.partitions()) == 1 and len(small.partitions()[0].paths) == 14
    for _ in range(2):
        ingest(stream_books(spark, folder, files_per_batch=5), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 14


def test_binary_markup():
    from codexa.sources.lit import PACKAGE, PAGE, atoms, attribute, markup, output_path, repaired, target, without_shared
    from codexa.plans.samples import element, record

    make = lambda text, **more: markup(text.encode(), PAGE, attribute, {"i1": "p/q.htm", "i2": "r.htm"}, **more)
    assert make(element(74, "a & b &amp; <\v\u00e9>", attributes=((0x83EA, 'x"<y'),))) == '<p class="x&quot;&lt;y">a &amp; b &amp; &lt;\n&#233;&gt;</p>'
    assert make(record(3, 17) + "t" + record(2)) == "<br />t"  # a close with nothing open is forgiven
    assert make(record(1, 74) + "x") == "<p>x</p>"  # so is a missing one
    assert make(element(3, "l", attributes=((0x01, "Xi1#f"),)), page="p/z.htm") == '<a href="q.htm#f">l</a>'
    assert make(element(53, attributes=((0x8BB9, "Xi2"),)), page="p/z.htm") == '<img src="../r.htm"></img>'
    assert make(record(1, 0x8000)[:-1] + "\x03my" + "\u8000\x02n\x02v" + "\0" + record(2)) == '<my n="v"></my>'
    assert make("\0\x11\x01\x01\x02v\0" + record(2), own=({1: "st"}, {1: "at"})) == '<st at="v"></st>'
    assert make(record(1, 74)[:-1] + "\u83ea\uffff\x06\0") == '<p class="5"></p>'
    for bad in ("\0\x01\x02", "\0\x01J\u7fff\x02a\0", "\0\x01J\u83ea\x09a"):
        with pytest.raises(Corrupt):
            make(bad)
    with pytest.raises(Corrupt):
        markup(b"\xff", PACKAGE, attribute, {})
    assert repaired("<package><metadata/></package><manifest/> ") == "<package><metadata/><manifest/></package>" and repaired("<package/>x") == "<package/>x"
    assert [output_path(p) for p in ("C:\\a\\b.htm", "../../a/./b", "a//b/../c")] == ["/a/b.htm", "a/b", "a/c"]
    assert without_shared({"a": "/x/y/1", "b": "/x/y/z/2"}) == {"a": "1", "b": "z/2"} and without_shared({"a": "/x/1", "b": "u/2"}) == {"a": "1", "b": "u/2"}
    assert target("Xnone", {}, "") == "none"
    assert atoms(b"\1\0\0\0\2ab\1\0\0\0\1\0\0\0c") == ({1: "ab"}, {1: "c"}) and atoms(b"\2\0\0\0\1a\x7f") == ({1: "a"}, {}) and atoms(b"") == ({}, {})


def test_help_pages_name_publisher_date_and_isbn():
    from codexa.functions.isbn import declared_isbn
    from codexa.sources.help_page import Page, date, isbn, publisher

    page = Page("<meta name=imprint content=X><meta property='DCTERMS.Publisher' content=' Kiadó: Y '><meta name=date content=2000><meta name=isbn content='no'><span class=ISBN10>0-306-40615-2</span>")
    assert (publisher(page), date(page), isbn(page)) == ("Y", "2000", "0306406152")
    page = Page("<table><tr><td><b>Publisher</b><td>no<tr><td>publisher<tr><td>The Publisher:<th>x</th></tr></table><meta name=identifier content='9780306406158'>")
    assert publisher(page) == "The Publisher:x" or publisher(page) == "x" and isbn(page) == ""
    assert declared_isbn(" ISBN-13: 978-0-306-40615-7 ") == "978-0-306-40615-7" and declared_isbn("x") is None
    assert len(Page("<div>" * 5000 + "deep").root.text()) == 4
