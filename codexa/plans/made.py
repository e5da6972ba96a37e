"""Queries over book files made from the conversations: one file of each kind for each conversation, then read back."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from codexa.functions import charset, markup
from codexa.functions.conversion import converted, to_text
from codexa.functions.strings import PLAIN
from codexa.plans.books import TEXT_SQL
from codexa.session import table
from codexa.sources import reader
from codexa.sources.detect import sniff

DC = 'xmlns:dc="http://purl.org/dc/elements/1.1/"'
KINDS = ("epub", "fb2", "mobi", "palmdoc", "ereader")


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _epub(key: int, turns: list) -> bytes:
    items = "".join(f'<item id="t{i}" href="t{i}.xhtml" media-type="application/xhtml+xml"/>' for i, _, _ in turns)
    refs = "".join(f'<itemref idref="t{i}"{"" if linear else " linear=\"no\""}/>' for i, linear, _ in turns)
    head = f'<dc:title>Book {key}</dc:title><dc:creator>Author {key % 7}</dc:creator><dc:subject>a; b{key % 3}</dc:subject><dc:identifier>urn:isbn:{key}</dc:identifier><dc:language>en</dc:language>'
    pages = {f"t{i}.xhtml": f"<html><head><title>t</title></head><body><p>{escape(text or '')}</p></body></html>" for i, _, text in turns}
    return _zip(
        {
            "mimetype": "application/epub+zip",
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="a.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
            "a.opf": f'<package version="3.0"><metadata {DC}>{head}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>',
            **pages,
        }
    )


def _fb2(key: int, turns: list) -> bytes:
    body = lambda which: "".join(f"<section><p>{escape(text or '')}</p></section>" for _, linear, text in turns if linear is which)
    info = f"<title-info><book-title>Book {key}</book-title><author><nickname>Author {key % 7}</nickname></author><genre>a</genre><genre>b{key % 3}</genre><lang>en</lang></title-info><publish-info><isbn>{key}</isbn></publish-info>"
    return f'<?xml version="1.0"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description>{info}</description><body>{body(True)}</body><body>{body(False)}</body></FictionBook>'.encode()


def _palm(kind: bytes, name: str, records: list[bytes]) -> bytes:
    at, places = 78 + 8 * len(records), b""
    for i, r in enumerate(records):
        places += struct.pack(">II", at, i)
        at += len(r)
    return name.encode().ljust(32, b"\0") + bytes(28) + kind + struct.pack(">IIH", 0, 0, len(records)) + places + b"".join(records)


def _mobi(key: int, turns: list) -> bytes:
    text = ("<html><body>" + "".join(f"<p>{escape(t or '')}</p>" for _, linear, t in turns if linear) + "</body></html>").encode()
    pages = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    fields = [(100, f"Author {key % 7}"), (104, str(key)), (105, f"a; b{key % 3}"), (503, f"Book {key}"), (524, "en")]
    rows = b"".join(struct.pack(">II", k, 8 + len(v.encode())) + v.encode() for k, v in fields)
    raw = bytearray(248)
    struct.pack_into(">HHIHHHH", raw, 0, 1, 0, len(text), len(pages), 4096, 0, 0)
    raw[16:20] = b"MOBI"
    struct.pack_into(">III", raw, 20, 232, 2, 65001)
    struct.pack_into(">I", raw, 36, 6)
    struct.pack_into(">I", raw, 128, 0x40)
    struct.pack_into(">I", raw, 168, 0xFFFFFFFF)
    return _palm(b"BOOKMOBI", f"b{key}", [bytes(raw) + b"EXTH" + struct.pack(">II", 12 + len(rows), len(fields)) + rows, *pages])


def _palmdoc(key: int, turns: list) -> bytes:
    text = "\n".join(t or "" for _, linear, t in turns if linear).encode("cp1252", "replace")
    return _palm(b"TEXtREAd", f"Book {key}", [struct.pack(">HHIHHI", 1, 0, len(text), 1, 4096, 0), *[text[i : i + 4096] for i in range(0, len(text), 4096)]])


def _ereader(key: int, turns: list) -> bytes:
    text = "\n".join((t or "").replace("\\", "\\\\") for _, linear, t in turns if linear).encode("cp1252", "replace")
    pages = [zlib.compress(text[i : i + 4096]) for i in range(0, len(text), 4096)]
    raw = bytearray(132)
    struct.pack_into(">H", raw, 0, 10)
    struct.pack_into(">H", raw, 12, len(pages) + 1)
    struct.pack_into(">H", raw, 24, 1)
    struct.pack_into(">H", raw, 44, len(pages) + 1)
    return _palm(b"PNRdPPrs", f"b{key}", [bytes(raw), *pages, f"Book {key}\0Author {key % 7}\0\0Pub\0{key}\0".encode()])


MAKERS = dict(zip(KINDS, (_epub, _fb2, _mobi, _palmdoc, _ereader), strict=True))


def _files(spark, sf, kind: str):
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("turn", (F.col("role") != "system").alias("linear"), "text"))).alias("turns"))
    make = MAKERS[kind]

    def build(keys: pd.Series, turns: pd.Series) -> pd.Series:
        return pd.Series([make(int(k), [(t["turn"], bool(t["linear"]), t["text"]) for t in ts]) for k, ts in zip(keys, turns, strict=True)])

    return rows.select(F.col("key").cast("string").alias("path"), F.pandas_udf(build, "binary")("key", "turns").alias("content"))


def _texts(kind: str):
    def query(spark, sf):
        texts = reader.book_texts(reader.parse_books(_files(spark, sf, kind)))
        return texts.select(F.col("book_id").cast("long").alias("book_id"), F.sha2("text", 256).alias("sha256"))

    return query


def _metadata(kind: str):
    def query(spark, sf):
        rows = reader.books(reader.parse_books(_files(spark, sf, kind), with_content=False))
        ids = F.array_join(F.transform("identifiers", lambda i: F.concat(i["scheme"], F.lit(":"), i["value"])), ",")
        return rows.select(F.col("path").cast("long").alias("book_id"), "file_type", "title", F.array_join("authors", ",").alias("authors"), F.array_join("subjects", ",").alias("subjects"), ids.alias("identifiers"), "error_code")

    return query


def epub_resources(spark, sf):
    rows = reader.resources(reader.parse_books(_files(spark, sf, "epub"), with_content=False))
    return rows.select(F.col("book_id").cast("long").alias("book_id"), F.col("pos").cast("long").alias("pos"), "id", "resolved_href", "charset")


def epub_reading_order(spark, sf):
    rows = reader.reading_order(reader.parse_books(_files(spark, sf, "epub"), with_content=False))
    return rows.select(F.col("book_id").cast("long").alias("book_id"), F.col("pos").cast("long").alias("pos"), "linear")


def detect_formats(spark, sf):
    every = [_files(spark, sf, k).select(F.lit(k).alias("kind"), sniff(F.col("content")).alias("found"), F.octet_length("content").alias("n")) for k in KINDS]
    out = every[0]
    for more in every[1:]:
        out = out.union(more)
    return out.groupBy("kind", "found").agg(F.count("*").alias("n_files"))


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[&<>]", "+").alias("text"))


def fb2_text(spark, sf):
    body = F.concat(F.lit("<body>"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), ""), F.lit("</body>"))
    return _lines(spark, sf).select("doc_id", F.sha2(to_text(body, markup.fb2_to_text), 256).alias("sha256"))


def pml_text(spark, sf):
    source = F.concat(F.lit("\\p\\x"), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\a046")), F.lit('\\Q="x"'))
    return _lines(spark, sf).select("doc_id", F.sha2(to_text(source, markup.pml_to_text), 256).alias("sha256"))


def lrf_text(spark, sf):
    return _lines(spark, sf).select("doc_id", F.sha2(to_text(F.replace("text", F.lit("."), F.lit("￼")), markup.lrf_to_text), 256).alias("sha256"))


def charset_round_trip(spark, sf):
    def run(texts: pd.Series) -> pd.Series:
        out = [charset.encode(t, label) for t, label in zip(texts, _cycle(len(texts)), strict=True)]
        return pd.Series([converted(b, "text/plain", PLAIN, label, "utf-8").decode() for b, label in zip(out, _cycle(len(texts)), strict=True)])

    return table(spark, sf, "documents").select("doc_id", F.sha2(F.pandas_udf(run, "string")("text"), 256).alias("sha256"))


def _cycle(n: int) -> list[str]:
    return [("windows-1252", "utf-16le", "utf-16be", "gb18030")[i % 4] for i in range(n)]


KEYS = "SELECT DISTINCT conv_id AS k FROM conversations"
SHA_SQL = f"SELECT book_id, sha256(text) AS sha256 FROM ({TEXT_SQL})"
_LINES = "SELECT doc_id, regexp_replace(text, '[&<>]', '+', 'g') AS t FROM documents"


def _meta_sql(kind: str, subjects: str, authors: str = "'Author ' || k % 7", ids: str = "'ISBN:' || k") -> str:
    return f"SELECT k AS book_id, '{kind}' AS file_type, 'Book ' || k AS title, {authors} AS authors, {subjects} AS subjects, {ids} AS identifiers, CAST(NULL AS VARCHAR) AS error_code FROM ({KEYS})"


QUERIES = {
    **{f"{kind}_text": (_texts(kind), SHA_SQL) for kind in KINDS},
    "epub_metadata": (_metadata("epub"), _meta_sql("epub", "'a,b' || k % 3")),
    "fb2_metadata": (_metadata("fb2"), _meta_sql("fb", "'a,b' || k % 3")),
    "mobi_metadata": (_metadata("mobi"), _meta_sql("mobi", "'a,b' || k % 3")),
    "palmdoc_metadata": (_metadata("palmdoc"), _meta_sql("palmdoc", "''", "''", "''")),
    "ereader_metadata": (_metadata("ereader"), _meta_sql("ereader", "''")),
    "epub_resources": (epub_resources, "SELECT conv_id AS book_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 't' || turn AS id, 't' || turn || '.xhtml' AS resolved_href, 'utf-8' AS charset FROM conversations"),
    "epub_reading_order": (epub_reading_order, "SELECT conv_id AS book_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role <> 'system' AS linear FROM conversations"),
    "detect_formats": (detect_formats, f"SELECT kind, CASE kind WHEN 'epub' THEN 'zip' WHEN 'palmdoc' THEN 'mobi' ELSE kind END AS found, (SELECT count(*) FROM ({KEYS})) AS n_files FROM (VALUES {', '.join(f'({k!r})' for k in KINDS)}) t(kind)"),
    "fb2_body_text": (fb2_text, f"SELECT doc_id, sha256(trim(array_to_string(list_transform(string_split(t, chr(10)), lambda x: ltrim(x, ' ' || chr(9) || chr(13))), chr(10)), chr(10))) AS sha256 FROM ({_LINES})"),
    "pml_text": (pml_text, f"SELECT doc_id, sha256(trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))) AS sha256 FROM ({_LINES})"),
    "lrf_text": (lrf_text, f"SELECT doc_id, sha256(replace(t, '.', '')) AS sha256 FROM ({_LINES})"),
    "charset_round_trip": (charset_round_trip, "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
}
