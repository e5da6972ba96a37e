"""Queries over book files of the less common kinds, made from the conversations and read back: packed texts, KF8, FB3, LRF, compiled help, protected files, limits."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from codexa.plans import samples as sp
from codexa.plans.books import TEXT_SQL
from codexa.plans.made import DC, KEYS, MAKERS, SHA_SQL, _epub, _zip
from codexa.session import table
from codexa.sources import reader
from codexa.sources.detect import detect

PNG = b"\x89PNG\r\n\x1a\n" + bytes(8)
# Locale codes of Palm books with their tags; the last has none.
PALM_CODES, PALM_NAMES = (0x0409, 0x0809, 0x0407, 0x0C07, 0x080A, 0x0801, 0x0804, 0x7C04, 0x1C1A, 0x043F, 0x0009), ("en-US", "en-GB", "de-DE", "de-AT", "es-MX", "ar-IQ", "zh-CN", "zh-Hant", "sr-Cyrl-BA", "kk", "")
REL = "http://www.fictionbook.org/FictionBook3/relationships/"
LCIDS = (0x409, 0x407, 0x40C, 0xC0A, 0x804, 0x404, 0x81A, 0x416)
LCID_NAMES = ("en", "de", "fr", "es", "zh-Hans", "zh-Hant", "sr-Latn", "pt")


def _html(turns: list) -> bytes:
    return ("<html><body>" + "".join(f"<p>{escape(t or '')}</p>" for _, linear, t in turns if linear) + "</body></html>").encode()


def _packed_mobi(key: int, turns: list) -> bytes:
    texts = [sp.lz77(x) for x in sp.cut(_html(turns))]
    return sp.palm(b"BOOKMOBI", [sp.mobi_header(len(texts), compression=2), *texts])


def _huff_mobi(key: int, turns: list) -> bytes:
    texts = [sp.huffman_coded(x) for x in sp.cut(_html(turns))]
    return sp.palm(b"BOOKMOBI", [sp.mobi_header(len(texts), compression=17480, huff=(len(texts) + 1, 2)), *texts, *sp.huffman()])


def _trailed_mobi(key: int, turns: list) -> bytes:
    """Each record ends with the bytes that belong to the next one's first character, counted in its last byte."""
    texts = [x + b"\0" for x in sp.cut(_html(turns))]
    return sp.palm(b"BOOKMOBI", [sp.mobi_header(len(texts), extra=1), *texts])


def _packed_palmdoc(key: int, turns: list) -> bytes:
    text = "\n".join(t or "" for _, linear, t in turns if linear).encode("cp1252", "replace")
    pages = [sp.lz77(x) for x in sp.cut(text)]
    return sp.palm(b"TEXtREAd", [struct.pack(">HHIHHI", 2, 0, len(text), len(pages), 4096, 0), *pages])


def _kf8(key: int, turns: list) -> bytes:
    body = "".join(f"<p>{escape(t or '')}</p>" for _, linear, t in turns if linear).encode()
    return sp.kf8(body, exth=[(503, f"Book {key}".encode()), (100, b"Ann"), (100, f"Author {key % 7}".encode())])


def _joint(key: int, turns: list) -> bytes:
    """An old book and a new one in a file; every third new one is broken, so that the old one is read."""
    body = _html(turns)
    second = sp.palm(b"BOOKMOBI", [sp.mobi_header(1, version=8, exth=[(503, f"New {key}".encode())], compression=17480 if key % 3 == 0 else 1), b"<p>new</p>"])
    first, cuts = struct.unpack_from(">II", second, 78)[0], struct.unpack_from(">I", second, 86)[0]
    texts = sp.cut(body)
    old = [sp.mobi_header(len(texts), exth=[(121, struct.pack(">I", len(texts) + 2)), (503, f"Old {key}".encode())]), *texts, b"BOUNDARY"]
    return sp.palm(b"BOOKMOBI", [*old, second[first:cuts], second[cuts:]])


def _fb3(key: int, turns: list) -> bytes:
    body = "".join(f"<section><p>{escape(t or '')}</p></section>" for _, linear, t in turns if linear)
    people = f'<subject link="author"><first-name>A</first-name><last-name>B{key % 7}</last-name></subject><subject link="editor"><last-name>C</last-name></subject>'
    about = (
        f'<fb3-description id="u-{key}"><title><main>Book  {key}</main></title><fb3-relations>{people}</fb3-relations><fb3-classification><subject>x</subject><subject>X</subject><subject>y{key % 3}</subject></fb3-classification>'
        f'<lang>ru</lang><annotation><p>N</p></annotation><paper-publish-info publisher="P{key % 5}" year="2000"><isbn>{key}</isbn></paper-publish-info></fb3-description>'
    )
    return sp.zipped(
        {
            "[Content_Types].xml": '<Types><Default Extension="png" ContentType="image/png"/><Override PartName="/fb3/body.xml" ContentType="application/fb3-body+xml"/></Types>',
            "_rels/.rels": f'<Relationships><Relationship Id="r" Type="{REL}Book" Target="fb3/description.xml"/></Relationships>',
            "fb3/description.xml": about,
            "fb3/_rels/description.xml.rels": f'<Relationships><Relationship Id="b" Type="{REL}body" Target="body.xml"/></Relationships>',
            "fb3/body.xml": f"<fb3-body>{body}</fb3-body>",
        }
    )


def _lrf(key: int, turns: list) -> bytes:
    info = (
        f"<Info><BookInfo><Title>Book {key}</Title><Author>Ann{key % 7}, and Bob &amp;&amp; Co</Author><Category>x; y{key % 3}</Category><Classification>X,z</Classification><Keyword>a; b</Keyword></BookInfo>"
        "<DocInfo><Language>en</Language></DocInfo></Info>"
    )
    return sp.lrf(sp.lrf_text(*[t or "" for _, linear, t in turns if linear]), info, PNG)


def _chm(key: int, turns: list) -> bytes:
    page = lambda t: f"<html><body><p>{escape(t or '')}</p></body></html>".encode("ascii", "xmlcharrefreplace")
    number = "0-306-40615-2"
    says = (
        f"<meta name='dc.publisher' content='Publisher: P{key % 5}'><meta name='dcterms.issued' content='2001'><meta name='isbn' content='ISBN {number} (pbk.)'>",
        f"<p><span class='x-Imprint'>Imprint : P{key % 5}</span> <span class=isbn13>978-0306406157</span>",
        f"<table><tr><td>The publisher<td>: P{key % 5}<tr><td>ISBN: {number}</table>",
        f"<meta property='DC:Identifier' content='isbn 1'><meta name='identifier' content='ISBN-10: {number}'><meta name=publisher content=' '>",
    )[key % 4]
    home = f"<html><head><title>Home</title><meta name='author' content='A; B{key % 3}'></head><body>{says}</body></html>"
    pages = {"/a.htm": home.encode()} | {f"/t{i}.htm": page(t) for i, _, t in turns}
    links = "".join(f'<li><object><param name="Local" value="t{i}.htm#x"></object>' for i, linear, _ in turns if linear)
    return sp.chm(pages | {"/a.hhc": f"<ul>{links}</ul>".encode()}, title=f"Help {key}", lcid=LCIDS[key % 8])


def _lit(key: int, turns: list) -> bytes:
    """Pages in a folder that all share, with links to each other; every third package closes too early, every fifth file has a licence."""
    n = len(turns)

    def page(i: int, text: str) -> str:
        link = sp.element(3, "", attributes=((0x01, f"Xt{turns[(i + 1) % n][0]}#x"),))
        return sp.element(50, sp.element(16, sp.element(74, text.replace("\n", "\v"), attributes=((0x83EA, "c"),)), link))

    files = {f"t{t}": (f"C:\\books\\one\\{'a' if t % 2 else 'b%20c'}\\t{t}.htm", page(i, text or "")) for i, (t, _, text) in enumerate(turns)}
    text = lambda number, value: sp.element(number, value)
    words = sp.element(20, sp.element(21, text(2, f"Book {key}"), text(3, f"Ann & B{key % 7}"), text(31, "en"), text(24, f"P{key % 5}"), text(22, "x; y"), text(29, f"urn:isbn:{key}")))
    items = sp.element(16, *[sp.record(3, 17, (0x06, f"t{t}"), (0x07, f"Xt{t}"), (0x08, "text/html")) for t, _, _ in turns])
    spine = sp.element(18, *[sp.record(3, 19, (0x0A, f"t{t}")) for t, linear, _ in turns if linear])
    start = sp.record(1, 1, (0x0B, "http://purl.org/dc/elements/1.1/"), (0x03, "{0}"))
    end = sp.record(2)
    meta = start + words + (end + items + spine if key % 3 == 0 else items + spine + end)
    return sp.lit(meta, files, {"/DRMStorage/Licenses/EUL": b"x"} if key % 5 == 4 else None)


def _cover_epub(key: int, turns: list) -> bytes:
    """The property, else the meta element names the cover; both or neither by key."""
    marked, named = key % 4 in (1, 2), key % 4 in (2, 3)
    items = f'<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="m" href="m.png" media-type="image/png"{" properties=\'cover-image\'" if marked else ""}/><item id="n" href="n.png" media-type="image/png"/>'
    meta = '<meta name="cover" content="n"/>' if named else ""
    opf = f'<package><metadata {DC}><dc:title>T</dc:title>{meta}</metadata><manifest>{items}</manifest><spine><itemref idref="a"/></spine></package>'
    container = '<container><rootfiles><rootfile full-path="a.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return sp.zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": container, "a.opf": opf, "a.xhtml": "<p>x</p>", "m.png": PNG, "n.png": PNG})


def _cover_mobi(key: int, turns: list) -> bytes:
    exth = [(201, struct.pack(">I", key % 2))] if key % 4 else []
    return sp.palm(b"BOOKMOBI", [sp.mobi_header(1, exth=exth, first_image=2), b"<p>x</p>", PNG, b"\xff\xd8\xff\xe0" + bytes(9), b"FLIS"])


def _cover_ereader(key: int, turns: list) -> bytes:
    raw = bytearray(132)
    for at, value in ((0, 10), (12, 2), (20, 1), (24, 1), (40, 2), (42, 0), (44, 3)):
        struct.pack_into(">H", raw, at, value)
    name = b"cover.png" if key % 2 else b"other.png"
    return sp.palm(b"PNRdPPrs", [bytes(raw), zlib.compress(b"text"), b"PNG " + name.ljust(32, b"\0") + bytes(26) + PNG, b"T\0A\0\0P\0\0"])


def _cover_chm(key: int, turns: list) -> bytes:
    home = f"<html><body><img src='i/{key % 3}.png' alt='{'The Cover' if key % 2 else 'A map'}'></body></html>".encode()
    return sp.chm({"/a.htm": home, "/i/0.png": PNG, "/i/1.png": PNG})


def _contents(key: int, turns: list) -> bytes:
    """Help with several tables of contents: the one beside the start page and of its name is taken; pages named twice or missing count once or not."""
    local = lambda *names: "".join(f'<object><param name="Local" value="{n}"></object>' for n in names).encode()
    pages = {"/d/a.htm": b"<p>A</p>", "/d/b.htm": b"<p>B</p>", "/c.htm": b"<p>C</p>", "/z.hhc": local("c.htm"), "/d/x.hhc": local("a.htm")}
    if key % 2:
        pages["/d/a.hhc"] = local("b.htm", "/c.htm#x", "b.htm;y", "none.htm", "a.htm")
    return sp.chm(pages, start="d/a.htm")


def _palm_kind(key: int, turns: list) -> bytes:
    """A PalmDOC record that is markup, plain text, or plain text that names an element late."""
    text = (b"\x0e\0 <HTML><body>x</body></html>", b"plain <b>x</b>", b"x" * 4096 + b"<html>", b"\n<Body>y</body>")[key % 4]
    pages = sp.cut(text)
    return sp.palm(b"TEXtREAd", [struct.pack(">HHIHHI", 1, 0, len(text), len(pages), 4096, 0), *pages])


def _locale(key: int, turns: list) -> bytes:
    return sp.palm(b"BOOKMOBI", [sp.mobi_header(1, language=PALM_CODES[key % len(PALM_CODES)]), b"<p>x</p>"])


def _rules(key: int, turns: list) -> bytes:
    """Files with and without protection, by key."""
    case = key % 8
    if case in (5, 6):
        return sp.palm(b"BOOKMOBI", [sp.mobi_header(1, drm=5 if case == 5 else sp.UNSET), b"<p>x</p>"])
    if case == 7:
        raw = bytearray(132)
        struct.pack_into(">H", raw, 0, 260)
        return sp.palm(b"PNRdPPrs", [bytes(raw)])
    method = '<encryption><EncryptionMethod Algorithm="{}"/></encryption>'
    more = (
        {}, {"META-INF/encryption.xml": method.format("http://www.w3.org/2001/04/xmlenc#aes128-cbc")}, {"META-INF/encryption.xml": method.format("http://www.idpf.org/2008/embedding")},
        {"META-INF/rights.xml": "<r/>", "t0.xhtml": "\x01\x02"}, {"META-INF/rights.xml": "<r/>"},
    )[case]
    with zipfile.ZipFile(io.BytesIO(_epub(key, turns))) as z:
        return _zip({n: z.read(n).decode() for n in z.namelist()} | more)


def _details(key: int, turns: list) -> bytes:
    """An EPUB whose metadata has wrappers, events, refinements and blanks."""
    date = ('<dc:date>1999</dc:date>', '<dc:date xmlns:opf="http://www.idpf.org/2007/opf" opf:event="modification">2001</dc:date>', '<dc:date>1998</dc:date><dc:date xmlns:opf="http://www.idpf.org/2007/opf" opf:event="Publication">1990</dc:date>')[key % 3]
    series = (
        '<meta property="belongs-to-collection" id="c">Saga</meta><meta refines="#c" property="collection-type">series</meta><meta refines="#c" property="group-position">2</meta>',
        '<meta name="calibre:series" content="Cycle"/><meta name="calibre:series_index" content="3.5"/>',
        '<meta property="belongs-to-collection" id="c">Set</meta><meta refines="#c" property="collection-type">set</meta>',
    )[key // 3 % 3]
    words = "<dc:language>fr</dc:language><dc:language>de</dc:language><dc:publisher> </dc:publisher><dc:publisher>Pub</dc:publisher><dc:description>About</dc:description>"
    opf = f'<package version="2.0"><metadata {DC}><dc:title>T{key}</dc:title>{words}{date}{series}</metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>'
    return _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="a.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', "a.opf": opf, "a.xhtml": "<p>x</p>"})


def _lenient(key: int, turns: list) -> bytes:
    """A FictionBook with a bare ampersand."""
    info = f"<title-info><book-title>Book {key} & more</book-title><annotation><p>One.</p><empty-line/><p>Two.</p></annotation><lang>en</lang></title-info>"
    return f'<?xml version="1.0"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description>{info}</description><body><section><p>x</p></section></body></FictionBook>'.encode()


FORMATS = {
    "mobi_lz77": _packed_mobi, "mobi_huffman": _huff_mobi, "mobi_trailed": _trailed_mobi, "palmdoc_lz77": _packed_palmdoc, "kf8": _kf8, "joint": _joint, "fb3": _fb3, "lrf": _lrf, "chm": _chm,
    "lit": _lit, "locale": _locale, "drm": _rules, "details": _details, "lenient": _lenient,
}


def _files(spark, sf, make):
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("turn", (F.col("role") != "system").alias("linear"), "text"))).alias("turns"))

    def build(keys: pd.Series, turns: pd.Series) -> pd.Series:
        return pd.Series([make(int(k), [(t["turn"], bool(t["linear"]), t["text"]) for t in ts]) for k, ts in zip(keys, turns, strict=True)])

    return rows.select(F.col("key").cast("string").alias("path"), F.pandas_udf(build, "binary")("key", "turns").alias("content"))


def _texts(kind: str):
    def query(spark, sf):
        texts = reader.book_texts(reader.parse_books(_files(spark, sf, FORMATS[kind])))
        return texts.select(F.col("book_id").cast("long").alias("book_id"), F.sha2("text", 256).alias("sha256"))

    return query


def _books(kind: str, *columns: str):
    def query(spark, sf):
        rows = reader.books(reader.parse_books(_files(spark, sf, FORMATS[kind]), with_content=False))
        joined = {c: F.array_join(c, "|") for c in ("authors", "subjects", "languages")} | {"identifiers": F.array_join(F.transform("identifiers", lambda i: F.concat(i["scheme"], F.lit(":"), i["value"])), "|")}
        return rows.select(F.col("path").cast("long").alias("book_id"), *[joined.get(c, F.col(c)).alias(c) for c in columns])

    return query


def detect_all(spark, sf):
    """Format of files of every kind, zipped ones and foreign ones too."""

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: detect(x) or "none")

    makers = {**MAKERS, **FORMATS, "fb2zip": lambda k, t: sp.zipped({"x.fb2": MAKERS["fb2"](k, t)}), "empty_lit": lambda k, t: b"ITOLITLS" + bytes(40), "short_lit": lambda k, t: b"ITOLITLS", "zip": lambda k, t: sp.zipped({"a": b"b"}), "text": lambda k, t: b"plain"}
    out = None
    for kind, make in makers.items():
        if kind in ("drm", "locale"):
            continue
        rows = _files(spark, sf, make).select(F.lit(kind).alias("kind"), F.pandas_udf(run, "string")("content").alias("found"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("kind", "found").agg(F.count("*").alias("n_files"))


FOUND = {
    "epub": "epub", "fb2": "fb2", "mobi": "mobi", "palmdoc": "mobi", "ereader": "ereader", "mobi_lz77": "mobi", "mobi_huffman": "mobi", "mobi_trailed": "mobi", "palmdoc_lz77": "mobi", "kf8": "mobi", "joint": "mobi",
    "fb3": "fb3", "lrf": "lrf", "chm": "chm", "details": "epub", "lenient": "fb2", "fb2zip": "fb2", "lit": "lit", "empty_lit": "lit", "short_lit": "none", "zip": "none", "text": "none",
}


def lit_links(spark, sf):
    """Stored paths of a LIT book's pages without what they share, and the links between them."""
    rows = reader.resources(reader.parse_books(_files(spark, sf, _lit)))
    return rows.select(F.col("book_id").cast("long").alias("book_id"), "id", "resolved_href", F.regexp_extract(F.col("content").cast("string"), 'href="([^"]*)"', 1).alias("link"), F.col("content").cast("string").contains('<p class="c">').alias("marked"))


def _fb2_charset(key: int, turns: list) -> bytes:
    """A FictionBook in a charset by key, declared or marked; the last one is none that XML allows."""
    name = ("utf-8", "windows-1252", "utf-16", "utf-16", "utf-32")[key % 5]
    body = "".join(f"<section><p>{escape(t or '')}</p></section>" for _, linear, t in turns if linear)
    text = f'<?xml version="1.0" encoding="{name}"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><book-title>Bücher {key}</book-title></title-info></description><body>{body}</body></FictionBook>'
    if name == "utf-16":
        return ("\ufeff" + text).encode("utf-16-le" if key % 5 == 2 else "utf-16-be")
    return text.encode({"windows-1252": "cp1252", "utf-32": "utf-32"}.get(name, name), "xmlcharrefreplace")


def fb2_charsets(spark, sf):
    parsed = reader.parse_books(_files(spark, sf, _fb2_charset))
    texts = reader.book_texts(parsed).select("book_id", "text")
    rows = reader.books(parsed).select(F.col("path").alias("book_id"), "title", F.col("error_code").isNull().alias("readable")).join(texts, "book_id", "left")
    return rows.select(F.col("book_id").cast("long").alias("book_id"), "title", "readable", F.sha2("text", 256).alias("sha256"))


COVERS = {"epub": _cover_epub, "mobi": _cover_mobi, "ereader": _cover_ereader, "chm": _cover_chm, "lrf": _lrf}


def book_covers(spark, sf):
    out = None
    for kind, make in COVERS.items():
        parsed = reader.parse_books(_files(spark, sf, make))
        cover = F.get("resources", F.col("cover_pos"))
        rows = parsed.select(F.lit(kind).alias("kind"), F.col("path").cast("long").alias("book_id"), F.when(F.col("cover_pos").isNotNull(), cover["name"]).alias("name"), F.when(F.col("cover_pos").isNotNull(), cover["media_type"]).alias("media_type"))
        out = rows if out is None else out.union(rows)
    return out


def help_order(spark, sf):
    parsed = reader.parse_books(_files(spark, sf, _contents))
    name = lambda o: F.get("resources", o["resource_pos"])["resolved_href"]
    return parsed.select(F.col("path").cast("long").alias("book_id"), F.array_join(F.transform("reading_order", name), ",").alias("pages"))


def palm_kinds(spark, sf):
    parsed = reader.parse_books(_files(spark, sf, _palm_kind))
    return parsed.select(F.col("path").cast("long").alias("book_id"), F.get("resources", F.lit(0))["media_type"].alias("media_type"))


def locale_codes(spark, sf):
    return _books("locale", "languages")(spark, sf)


def read_path(spark, sf):
    """A path read as books: the table's files are none."""
    rows = reader.books(reader.read_books(spark, f" {sf}/region.parquet "))
    return rows.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "error_code", (F.length("sha256") == 64).alias("has_digest")).where("name like '%.parquet'").select("error_code", "has_digest").distinct()


LIMIT = 4_000


def resource_limit(spark, sf):
    """Parts over a limit are rows with an error, and fail nothing else."""
    wide = lambda key, turns: _epub(key, [(i, linear, (text or "") * 10) for i, linear, text in turns])
    rows = reader.resources(reader.parse_books(_files(spark, sf, wide), max_resource=LIMIT))
    return rows.where("media_type = 'application/xhtml+xml'").select(F.col("book_id").cast("long").alias("book_id"), "id", "error_code")


def fb2_images(spark, sf):
    """Embedded pictures: names made safe and kept apart, base64 with white space."""

    def make(key: int, turns: list) -> bytes:
        data = "iVBO\n Rw0K\tGgoAAAAAAAAAAA=="
        pictures = "".join(f'<binary id="{n}" content-type="image/png">{data}</binary>' for n in ("c.png", "c.png", f"a b{key % 3}.png", "ü.png"))
        return f'<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><book-title>B</book-title></title-info></description><body><p>x</p></body>{pictures}</FictionBook>'.encode()

    rows = reader.resources(reader.parse_books(_files(spark, sf, make)))
    return rows.where("media_type = 'image/png'").select(F.col("book_id").cast("long").alias("book_id"), "name", F.sha2("content", 256).alias("sha256"), F.col("size").alias("n_bytes"))


_PAGE = "octet_length(encode('<html><head><title>t</title></head><body><p>' || replace(replace(replace(repeat(coalesce(text, ''), 10), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></body></html>'))"
_PALM_SQL = "[" + ", ".join(f"'{x}'" for x in PALM_NAMES) + "]"
_LCID_SQL = "[" + ", ".join(f"'{x}'" for x in LCID_NAMES) + "]"


def _sql(**columns: str) -> str:
    return f"SELECT k AS book_id, {', '.join(f'{v} AS {c}' for c, v in columns.items())} FROM ({KEYS})"


_FOLDER = "CASE WHEN {0} % 2 = 1 THEN 'a' ELSE 'b c' END"
_LIT_FILES = f"""SELECT conv_id, turn, (SELECT count(*) FROM conversations o WHERE o.conv_id = c.conv_id) AS n, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), min(turn) OVER (PARTITION BY conv_id)) AS next,
  count(DISTINCT turn % 2) OVER (PARTITION BY conv_id) AS folders FROM conversations c WHERE conv_id % 5 <> 4"""
_LIT_SQL = f"""SELECT conv_id AS book_id, 't' || turn AS id, CASE WHEN folders = 2 THEN {_FOLDER.format("turn")} || '/' ELSE '' END || 't' || turn || '.htm' AS resolved_href,
  CASE WHEN folders = 2 AND turn % 2 <> next % 2 THEN '../' || {_FOLDER.format("next")} || '/' ELSE '' END || 't' || next || '.htm#x' AS link, true AS marked FROM ({_LIT_FILES}) WHERE n > 1"""

COVER_SQL = (
    ("epub", "[NULL, 'm.png', 'm.png', 'n.png'][k % 4 + 1]", "CASE WHEN k % 4 > 0 THEN 'image/png' END"),
    ("mobi", "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 1 THEN 'image00002.jpg' ELSE 'image00001.png' END", "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 1 THEN 'image/jpeg' ELSE 'image/png' END"),
    ("ereader", "CASE WHEN k % 2 = 1 THEN 'cover.png' END", "CASE WHEN k % 2 = 1 THEN 'image/png' END"),
    ("chm", "CASE WHEN k % 2 = 1 AND k % 3 < 2 THEN (k % 3) || '.png' END", "CASE WHEN k % 2 = 1 AND k % 3 < 2 THEN 'image/png' END"),
    ("lrf", "'cover.png'", "'image/png'"),
)

QUERIES = {
    "mobi_lz77_text": (_texts("mobi_lz77"), SHA_SQL),
    "mobi_huffman_text": (_texts("mobi_huffman"), SHA_SQL),
    "mobi_trailed_text": (_texts("mobi_trailed"), SHA_SQL),
    "palmdoc_lz77_text": (_texts("palmdoc_lz77"), SHA_SQL),
    "kf8_text": (_texts("kf8"), SHA_SQL),
    "joint_text": (_texts("joint"), f"SELECT book_id, sha256(CASE WHEN book_id % 3 = 0 THEN text ELSE 'new' END) AS sha256 FROM ({TEXT_SQL})"),
    "fb3_text": (_texts("fb3"), SHA_SQL),
    "lrf_book_text": (_texts("lrf"), f"SELECT book_id, sha256(chr(10) || chr(10) || text) AS sha256 FROM ({TEXT_SQL})"),
    "chm_text": (_texts("chm"), SHA_SQL),
    "lit_text": (_texts("lit"), f"SELECT book_id, sha256(text) AS sha256 FROM ({TEXT_SQL}) WHERE book_id % 5 <> 4"),
    "lit_metadata": (_books("lit", "file_type", "version", "title", "authors", "languages", "publisher", "subjects", "identifiers", "error_code"), _sql(**{c: f"CASE WHEN k % 5 <> 4 THEN {v} ELSE '' END" for c, v in dict(file_type="'lit'", version="'1'", title="'Book ' || k", authors="'Ann & B' || k % 7", languages="'en'", publisher="'P' || k % 5", subjects="'x|y'", identifiers="'ISBN:' || k").items()}, error_code="CASE WHEN k % 5 = 4 THEN 'DRM' END")),
    "lit_links": (lit_links, _LIT_SQL),
    "book_covers": (book_covers, " UNION ALL ".join(f"SELECT '{kind}' AS kind, k AS book_id, {name} AS name, {mime} AS media_type FROM ({KEYS})" for kind, name, mime in COVER_SQL)),
    "fb2_charsets": (fb2_charsets, f"SELECT book_id, CASE WHEN book_id % 5 < 4 THEN 'Bücher ' || book_id ELSE '' END AS title, book_id % 5 < 4 AS readable, CASE WHEN book_id % 5 < 4 THEN sha256(text) END AS sha256 FROM ({TEXT_SQL})"),
    "help_order": (help_order, _sql(pages="CASE WHEN k % 2 = 1 THEN 'd/b.htm,c.htm,d/a.htm' ELSE 'd/a.htm' END")),
    "palm_kinds": (palm_kinds, _sql(media_type="['application/x-mobipocket-html', 'text/plain', 'text/plain', 'application/x-mobipocket-html'][k % 4 + 1]")),
    "locale_codes": (locale_codes, _sql(languages=f"{_PALM_SQL}[k % {len(PALM_CODES)} + 1]")),
    "kf8_metadata": (_books("kf8", "version", "title", "authors"), _sql(version="'8'", title="'Book ' || k", authors="'Ann|Author ' || k % 7")),
    "joint_metadata": (_books("joint", "version", "title"), _sql(version="'6/8'", title="'New ' || k")),
    "fb3_metadata": (_books("fb3", "file_type", "title", "authors", "subjects", "languages", "description", "publisher", "publication_date", "identifiers"), _sql(file_type="'fb'", title="'Book ' || k", authors="'A B' || k % 7", subjects="'x|y' || k % 3", languages="'ru'", description="'N'", publisher="'P' || k % 5", publication_date="'2000'", identifiers="'UUID:u-' || k || '|ISBN:' || k")),
    "lrf_metadata": (_books("lrf", "title", "authors", "subjects", "languages", "version"), _sql(title="'Book ' || k", authors="'Ann' || k % 7 || '|Bob & Co'", subjects="'x|y' || k % 3 || '|z|a; b'", languages="'en'", version="'999'")),
    "chm_metadata": (_books("chm", "title", "authors", "languages", "publisher", "publication_date", "identifiers", "version"), _sql(title="'Help ' || k", authors="'A|B' || k % 3", languages=f"{_LCID_SQL}[k % 8 + 1]", publisher="CASE WHEN k % 4 < 3 THEN 'P' || k % 5 ELSE '' END", publication_date="CASE k % 4 WHEN 0 THEN '2001' ELSE '' END", identifiers="'ISBN:' || ['0306406152', '9780306406157', '0306406152', '0-306-40615-2'][k % 4 + 1]", version="'3'")),
    "epub_details": (_books("details", "languages", "publisher", "description", "publication_date", "series", "series_index"), _sql(languages="'fr|de'", publisher="'Pub'", description="'About'", publication_date="['1999', '', '1990'][k % 3 + 1]", series="['Saga', 'Cycle', ''][k // 3 % 3 + 1]", series_index="['2', '3.5', ''][k // 3 % 3 + 1]")),
    "fb2_lenient": (_books("lenient", "title", "description", "error_code"), _sql(title="'Book ' || k || ' & more'", description="'One.' || chr(10) || chr(10) || 'Two.'", error_code="CAST(NULL AS VARCHAR)")),
    "drm_flags": (_books("drm", "error_code"), _sql(error_code="CASE WHEN k % 8 IN (1, 3, 5, 7) THEN 'DRM' END")),
    "detect_all": (detect_all, f"SELECT kind, found, (SELECT count(*) FROM ({KEYS})) AS n_files FROM (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in FOUND.items())}) t(kind, found)"),
    "read_path": (read_path, "SELECT 'UNSUPPORTED_FORMAT' AS error_code, true AS has_digest"),
    "resource_limit": (resource_limit, f"SELECT conv_id AS book_id, 't' || turn AS id, CASE WHEN {_PAGE} > {LIMIT} THEN 'LIMIT_EXCEEDED' END AS error_code FROM conversations"),
    "fb2_images": (fb2_images, f"SELECT k AS book_id, unnest(['c.png', 'c-2.png', 'a_b' || k % 3 || '.png', 'ü.png']) AS name, sha256(from_hex('89504E470D0A1A0A0000000000000000')) AS sha256, 16::BIGINT AS n_bytes FROM ({KEYS})"),
}
