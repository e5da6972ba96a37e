"""Small books of each format, made in memory."""

import base64
import struct
import zlib

from codexa.plans import samples
from codexa.plans.samples import kf8, lzx_literals, lzx_plain, mobi_header, palm, tag, zipped  # noqa: F401


CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/a.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
<dc:title> A &amp; B </dc:title><dc:creator opf:role="aut">Ann</dc:creator><dc:creator opf:role="ill">Ill</dc:creator><dc:creator opf:file-as="Bob, X"> </dc:creator><dc:subject>x; y</dc:subject><dc:subject>x</dc:subject>
<dc:language>en</dc:language><dc:date opf:event="modification">2001</dc:date><dc:date opf:event="Publication">1999</dc:date><dc:publisher>P</dc:publisher><dc:description>D</dc:description>
<dc:identifier id="i1">urn:isbn:9780306406157</dc:identifier><dc:identifier opf:scheme="calibre">77</dc:identifier><dc:source id="s">0306406152</dc:source><meta refines="#s" property="identifier-type">15</meta>
<meta property="belongs-to-collection" id="c">Saga</meta><meta refines="#c" property="collection-type">series</meta><meta refines="#c" property="group-position">2</meta><meta name="cover" content="img"/></metadata>
<manifest><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="sub/../c2.xhtml#f" media-type="application/xhtml+xml"/><item id="dup" href="c1.xhtml" media-type="application/xhtml+xml"/>
<item id="img" href="i.png" media-type="image/png"/><item id="gone" href="gone.css" media-type="text/css"/></manifest><spine><itemref idref="c1"/><itemref idref="c2" linear="no"/><itemref idref="dup"/><itemref idref="nope"/></spine></package>"""
PNG = b"\x89PNG\r\n\x1a\n" + bytes(8)


def epub(**more):
    page = '<?xml version="1.0" encoding="windows-1251"?><html><head><title>t</title></head><body><p>{}</p></body></html>'
    files = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/a.opf": OPF, "OEBPS/c1.xhtml": page.format("Привет").encode("cp1251"), "OEBPS/c2.xhtml": page.format("ISBN 0-306-40615-2").encode("cp1251"), "OEBPS/i.png": PNG}
    return zipped({**files, **more})


FB2 = """<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><genre>sf</genre><author><first-name>Ann</first-name><last-name>Lee</last-name></author>
<book-title>Title & more</book-title><annotation><p>One.</p><empty-line/><p>Two.</p></annotation><keywords>a, SF,b</keywords><date>1980</date><coverpage><image l:href="#c.png"/></coverpage><lang>en</lang><sequence name="S" number="3"/></title-info>
<document-info><id>uuid:1-2</id></document-info><publish-info><publisher>Pub</publisher><year>1990</year><isbn>0306406152</isbn></publish-info></description>
<body><title><p>T</p></title><section><p>Hello <!-- <body> --> <![CDATA[</body>]]></p></section></body><body name="notes"><p>note</p></body>
<binary id="c.png" content-type="image/png">{}</binary><binary id="c.png" content-type="image/png">{}</binary><binary id="x" content-type="text/css">aa</binary></FictionBook>""".replace("{}", base64.b64encode(PNG).decode())


def fb3():
    rel = "http://www.fictionbook.org/FictionBook3/relationships/"
    return zipped(
        {
            "[Content_Types].xml": '<Types><Default Extension="png" ContentType="image/png"/><Override PartName="/fb3/body.xml" ContentType="application/fb3-body+xml"/></Types>',
            "_rels/.rels": f'<Relationships><Relationship Id="r1" Type="{rel}Book" Target="fb3/description.xml"/><Relationship Id="t" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/thumbnail" Target="img/c.png"/></Relationships>',
            "fb3/description.xml": '<fb3-description id="u-1"><title><main>Main  title</main></title><fb3-relations><subject link="author"><first-name>A</first-name><last-name>B</last-name></subject><subject link="editor"><last-name>C</last-name></subject></fb3-relations><fb3-classification><subject>x</subject><subject>X</subject></fb3-classification><lang>ru</lang><annotation><p>N</p></annotation><paper-publish-info publisher="P" year="2000"><isbn>0306406152</isbn></paper-publish-info></fb3-description>',
            "fb3/_rels/description.xml.rels": f'<Relationships><Relationship Id="b" Type="{rel}body" Target="body.xml"/></Relationships>',
            "fb3/body.xml": "<fb3-body><section><p>One</p><ul><li>Two</li></ul></section></fb3-body>",
            "fb3/_rels/body.xml.rels": '<Relationships><Relationship Id="i" Type="image" Target="../img/c.png"/></Relationships>',
            "img/c.png": PNG,
        }
    )


def mobi6(**more):
    exth = [(100, b"Ann"), (105, b"x; y"), (104, b"0306406152"), (503, b"New title"), (201, struct.pack(">I", 0)), (113, b"B00")]
    texts = [b"<html><body><p>One", b" two</p></body></html>#"]
    return palm(b"BOOKMOBI", [mobi_header(2, exth=exth, first_image=3, **more), *texts, PNG, b"FLIS"])


def joint(broken=False):
    second = palm(b"BOOKMOBI", [mobi_header(1, version=8, exth=[(503, b"Eight")], compression=17480 if broken else 1), b"<p>new</p>"])
    first = [mobi_header(1, exth=[(121, struct.pack(">I", 3)), (503, b"Six")]), b"<p>old</p>", b"BOUNDARY"]
    at = struct.unpack_from(">II", second, 78)[0]
    cut = struct.unpack_from(">I", second, 86)[0]
    return palm(b"BOOKMOBI", [*first, second[at:cut], second[cut:]])


def palmdoc(text=b"Hello\x80\x2bworld", compression=2):
    return palm(b"TEXtREAd", [struct.pack(">HHIHHI", compression, 0, 99, 1, 4096, 0), text])


def ereader(compression=10):
    raw = bytearray(132)
    struct.pack_into(">H", raw, 0, compression)
    struct.pack_into(">H", raw, 12, 2)
    struct.pack_into(">H", raw, 20, 1)
    struct.pack_into(">H", raw, 24, 1)
    struct.pack_into(">HHH", raw, 40, 2, 0, 3)
    image = b"PNG " + b"cover.png".ljust(32, b"\0") + bytes(26) + PNG
    return palm(b"PNRdPPrs", [bytes(raw), zlib.compress(rb"\pChapter\p \iHi\i"), image, b"Title\0Author\0Rights\0Pub\x000306406152\0"])


def lrf(key=0x30):
    text = tag(0xA1, bytes(4)) + "Hi".encode("utf-16-le") + tag(0xD1, bytes(12)) + tag(0xCC, struct.pack("<H", 4) + " x".encode("utf-16-le")) + tag(0xD2) + "y".encode("utf-16-le")
    info = "<Info><BookInfo><Title>T</Title><Author>A and B &amp;&amp; C</Author><Category>x, y</Category><Keyword>X</Keyword></BookInfo><DocInfo><Language>en</Language></DocInfo></Info>"
    return samples.lrf(text, info, PNG, key)


def chm(pages=None):
    return samples.chm(pages or {"/a.htm": b"<html><head><title>Home</title><meta name=author content='A; B'></head><body>One</body></html>", "/b.htm": b"<p>Two</p>", "/t.hhc": b'<ul><li><object><param name="Local" value="b.htm#x"></object><li><object><param name="Local" value="a.htm"></object></ul>'})


def lit():
    page = samples.element(50, samples.element(16, samples.element(74, "Lit page")))
    words = samples.element(20, samples.element(21, samples.element(2, "Title"), samples.element(3, "Ann")))
    items = samples.element(16, samples.record(3, 17, (0x06, "a"), (0x07, "Xa"), (0x08, "text/html")))
    meta = samples.element(1, words, items, samples.element(18, samples.record(3, 19, (0x0A, "a"))), attributes=((0x0B, "http://purl.org/dc/elements/1.1/"),))
    return samples.lit(meta, {"a": ("a.htm", page)})
