"""Queries on the small rules: hrefs, names, lists, ISBNs, scans, ids, conversions; each with made input whose answer SQL can state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from codexa.functions import charset, isbn, markup
from codexa.functions import strings as st
from codexa.functions.conversion import DEFAULT, Registry, convert, converted, default_registry, to_text
from codexa.functions.fingerprint import hamming
from codexa.operators import dedup
from codexa.operators import resources as rs
from codexa.operators import scan as sc
from codexa.plans.books import FIRST_SQL, TEXT_SQL, _parts, _resources
from codexa.plans.formats import _files
from codexa.plans.made import _epub
from codexa.plans.text import ISBN_SQL, MIN_SQL, PLACEHOLDER_SQL, SIMHASH_SQL, _written
from codexa.session import table
from codexa.sources import reader

PART = "SELECT p_partkey AS k, p_name, p_type, p_brand FROM part"


def _rows(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type", "p_brand")


def _pick(k, *values):
    """One of the values by key."""
    return F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (k % len(values)).cast("int"))


def resolve_path(spark, sf):
    href = _pick(F.col("k"), "a.x", "../a.x#f", "./b/../a.x?q", "/c/a.x")
    return _rows(spark, sf).select("k", st.resolve_href(F.concat(F.lit("O"), (F.col("k") % 9).cast("string"), F.lit("/p.opf")), href).alias("path"))


SAMPLES = ("FFD8FFE000", "89504E470D0A1A0A00", "89504E47", "474946383961", "20200A3C73766720", "613C3F786D6C20", "00010203", "")


def image_media(spark, sf):
    content = F.unhex(_pick(F.col("k"), *SAMPLES))
    return _rows(spark, sf).select("k", st.image_type(content).alias("media_type"))


def split_values(spark, sf):
    return _rows(spark, sf).select("k", F.array_join(st.split_list(F.concat_ws(" ;, ", "p_type", "p_brand", F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(",")))), "|").alias("parts"))


def author_names(spark, sf):
    names = F.concat(F.initcap("p_brand"), _pick(F.col("k"), " & ", " and ", ", with ", " AND ", "&"), F.lit("Smith && Co"))
    return _rows(spark, sf).select("k", F.array_join(st.split_authors(names), "|").alias("authors"))


def squashed(spark, sf):
    return _rows(spark, sf).select("k", st.squash(F.concat(F.lit(" \t"), F.replace("p_type", F.lit(" "), F.lit("\n  ")), F.lit("\r "), "p_name", F.lit(" "))).alias("text"))


def topic_paths(spark, sf):
    path = _pick(F.col("k"), F.concat(F.lit("a"), F.col("k").cast("string"), F.lit(".htm#x")), "/b.htm;c", "http://x.org/a", "JavaScript:go()", " ", " c.htm ")
    return _rows(spark, sf).select("k", st.topic_path(path).alias("path"))


def help_media(spark, sf):
    return _rows(spark, sf).select("k", st.help_type(F.concat(F.lit("/d.e/f"), _pick(F.col("k"), ".HTM", ".html", ".css", ".png", ".jpeg", ".gif", ".zzz", ""))).alias("media_type"))


def publishers(spark, sf):
    return _rows(spark, sf).select("k", st.clean_publisher(F.concat(_pick(F.col("k"), "", "Publisher: ", " IMPRINT :", "Press: "), F.col("p_brand"), F.lit(" "))).alias("publisher"))


def file_names(spark, sf):
    name = F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), _pick(F.col("k"), " é.png", "?.png", "_a-b.c")))
    return _rows(spark, sf).select("k", st.file_name(name).alias("name"))


def palm_times(spark, sf):
    at = F.when(F.col("k") % 4 == 0, F.lit(0)).otherwise(F.lit(2082844800) + F.col("k").cast("long") * 86_399)
    return _rows(spark, sf).select("k", F.date_format(st.palm_time(at), "yyyy-MM-dd HH:mm:ss").alias("moment"))


def identifier_lookup(spark, sf):
    key = F.col("k").cast("string")
    ids = F.array(F.struct(F.lit("isbn").alias("scheme"), F.when(F.col("k") % 2 == 0, key).otherwise("").alias("value")), F.struct(F.lit("ISBN").alias("scheme"), F.concat(F.lit("b"), key).alias("value")), F.struct(F.lit("x").alias("scheme"), key.alias("value")))
    return _rows(spark, sf).select("k", st.find_identifier(ids, "Isbn").alias("isbn"), st.find_identifier(ids, "doi").alias("doi"))


# ISBNs


def isbn_validate(spark, sf):
    rows = _written(spark, sf).select("key", isbn.validate(F.col("written")).alias("isbn"), isbn.is_valid(F.col("written")).alias("valid"))
    return rows.select("key", "isbn", isbn.kind(F.col("isbn")).cast("long").alias("kind"), "valid")


def isbn_find(spark, sf):
    rows = _written(spark, sf)
    text = F.concat(F.lit("Printed in 2001. ISBN "), "isbn13", F.lit(" (hardback), also "), "isbn10", F.lit("; order no. "), F.col("key").cast("string"))
    return rows.select("key", F.array_join(isbn.find_isbns(text), ",").alias("isbns"))


def isbn_declared(spark, sf):
    rows = _written(spark, sf)
    label = _pick(F.col("key"), "ISBN-13: ", "isbn", "urn:isbn:", "ISBN10:", "")
    return rows.select("key", isbn.of_digits(F.concat(F.lit("(pbk.) "), "isbn10", F.lit(" / "))).alias("digits"), isbn.declared(F.concat(label, "isbn13")).alias("declared"))


_CODE = PLACEHOLDER_SQL[PLACEHOLDER_SQL.index("CASE WHEN core") : PLACEHOLDER_SQL.index(" AS BIGINT) AS placeholder")]
CHECKED = f"(SELECT *, {_CODE} AS code FROM (SELECT key, isbn10, isbn13, body AS core FROM ({ISBN_SQL})))"

# scans of reading orders


def head_capture(spark, sf):
    return sc.scan(rs.reading_text(sc.heads_only(_parts(spark, sf), 200), "\n"), sc.text_head(200))


def scan_all(spark, sf):
    rows = sc.scan_reading_order(_parts(spark, sf), sc.Processor("sha256", lambda t: F.sha2(t, 256)), sc.text_head(100), None, sc.Processor("n_chars", lambda t: F.length(t).cast("long")))
    return rows.select("book_id", "sha256", "head", "n_chars")


def scan_fingerprints(spark, sf):
    rows = sc.text_with_fingerprint(_parts(spark, sf), n=16)
    return rows.select("book_id", F.sha2("text", 256).alias("sha256"), F.col("fingerprint.simhash").alias("simhash"), F.get("fingerprint.minhash", F.lit(0)).alias("first_minimum"))


def _with_isbns(spark, sf):
    """Each part names the ISBN of its book and place, some in the linear text, some only in other parts."""
    body = F.lpad(((F.col("book_id") * 1000 + F.col("pos")) * 7919 % 1_000_000_000).cast("string"), 9, "0")
    full = F.concat(F.lit("978"), body, isbn.check_digit_13(F.concat(F.lit("978"), body)))
    return _parts(spark, sf).withColumn("linear", F.col("pos") % 3 != 2).withColumn("in_order", F.col("pos") % 6 != 5).withColumn("text", F.concat(F.lit("x ISBN "), full, F.lit(" y")))


def fallback_isbn(spark, sf):
    return sc.book_isbns(_with_isbns(spark, sf)).select("book_id", F.array_join("isbns", ",").alias("isbns"))


def fallback_isbn_limited(spark, sf):
    return sc.book_isbns(_with_isbns(spark, sf), window=60, limit=3).select("book_id", F.array_join("isbns", ",").alias("isbns"))


_BODY = "lpad(CAST((conv_id * 1000 + turn) * 7919 % 1000000000 AS VARCHAR), 9, '0')"
_SUM = "38 + " + " + ".join(f"CAST(b[{i}] AS INT) * {(3, 1)[(i + 1) % 2]}" for i in range(1, 10))
_NAMED = f"""SELECT book_id, pos, phase, {_CODE.replace("core", "b")} AS code, '978' || b || CAST((10 - ({_SUM}) % 10) % 10 AS VARCHAR) AS isbn, row_number() OVER (PARTITION BY book_id, phase ORDER BY pos) AS r
  FROM (SELECT conv_id AS book_id, turn AS pos, {_BODY} AS b, CASE WHEN turn % 3 <> 2 THEN 0 WHEN turn % 6 <> 5 THEN 1 ELSE 2 END AS phase FROM conversations)"""
# of 60 bytes the third part's number is cut off: a part has 22 bytes and a newline after it
_SCAN = "SELECT book_id, string_agg(isbn, ',' ORDER BY phase, pos) AS isbns FROM ({}) WHERE code = 0 GROUP BY book_id"
_LIMITED = f"SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY phase, pos) AS n FROM ({_NAMED}) WHERE code = 0 AND (phase > 0 OR r <= 2)"

# resources


def id_lookup(spark, sf):
    res = _resources(spark, sf)
    wanted = res.where("pos % 3 = 0").select("book_id", "id").union(res.select("book_id", F.lit("none").alias("id")).distinct())
    return rs.by_id(res, wanted).select("book_id", "id", "pos")


def resource_lookup(spark, sf):
    res = _resources(spark, sf)
    wanted = res.where("pos % 3 = 0").select("book_id", F.concat(F.col("href"), F.lit("#x")).alias("href")).distinct()
    return rs.by_href(res, wanted).select("book_id", "id", "pos").distinct()


def _colliding(spark, sf):
    """Resources of few books with few ids and few hrefs."""
    res = _resources(spark, sf)
    return res.select((F.col("pos") % 7).cast("string").alias("book_id"), "pos", F.concat(F.lit("i"), (F.col("pos") % 5).cast("string")).alias("id"), F.concat(F.lit("d/../f"), (F.col("pos") % 12).cast("string"), F.when(F.col("pos") % 2 == 0, "#x").otherwise("")).alias("href"))


_COLLIDING = "SELECT CAST(page_id % 7 AS VARCHAR) AS book_id, page_id AS pos, 'i' || page_id % 5 AS id, 'f' || page_id % 12 AS href_key FROM pages"
_FREE = f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY book_id, href_key ORDER BY pos) AS r, row_number() OVER (PARTITION BY book_id, id ORDER BY pos) AS seen FROM ({_COLLIDING})),
  f AS (SELECT *, sum(CASE WHEN seen > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, id ORDER BY pos) AS n FROM c WHERE r = 1)"""


def id_collisions(spark, sf):
    return rs.canonical_ids(_colliding(spark, sf)).select("book_id", "pos", "href_key", "id")


def alias_rows(spark, sf):
    same = _colliding(spark, sf).withColumn("id", F.concat(F.lit("p"), F.col("pos").cast("string")))
    return rs.aliases(same).select("book_id", "id", "resource_pos")


def cover_alias(spark, sf):
    rows = _colliding(spark, sf)
    books = rows.select("book_id").distinct()
    covers = books.select("book_id", F.lit("i1").alias("id"), F.when(F.col("book_id") % 2 == 0, "./f3").otherwise("cover.png").alias("href"))
    return rs.with_cover(rows, covers).select("book_id", "pos", "id", "is_new")


# conversions


def fb3_body_text(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[&<>]", "+").alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>")))
    return rows.select("doc_id", F.sha2(to_text(F.concat(F.lit("<fb3-body><section><ul>"), F.array_join(lines, ""), F.lit("</ul><p>a<br/>b</p></section></fb3-body>")), markup.fb3_to_text), 256).alias("sha256"))


def conversion_graph(spark, sf):
    """Shortest paths of the default graph, and of one of its own with an alias and a detour."""
    own = Registry().register("a/a", "b/b", str.upper).register("b/b", "c/c", str.strip).register("a/a", "d/d", str.lower).register("d/d", "e/e", str.lower).register("e/e", "c/c", str.lower).alias("a/a", "A/Z; q=1")
    asked = [("own", own, a, b) for a, b in (("a/a", "c/c"), ("a/z", "c/c"), ("c/c", "a/a"), ("x/x", "X/X;y"), ("a/a", "e/e"))]
    asked += [("default", DEFAULT, a, "text/plain") for a in sorted({a for a, _ in default_registry().steps})]
    rows = [(g, a, b, -1 if (path := graph.path(a, b)) is None else len(path)) for g, graph, a, b in asked]
    return spark.createDataFrame(rows, "graph string, source string, target string, steps long")


def custom_conversion(spark, sf):
    """A graph of one's own: two steps in a row, and types that it does not know."""
    own = Registry().register("text/plain", "x/upper", str.upper).register("x/upper", "x/marked", lambda t: f"[{t}]")
    kind = F.when(F.col("doc_id") % 4 == 0, "text/html").otherwise("Text/Plain; charset=utf-8")
    rows = table(spark, sf, "documents").select("doc_id", convert(F.regexp_replace("text", "[^a-z ]", "").cast("binary"), kind, "x/marked", registry=own).alias("c"))
    return rows.select("doc_id", F.sha2("c.data", 256).alias("sha256"), F.col("c.error").alias("error"))


LABELS = (" UTF8 ", "ascii", "US-ASCII", "cp1251", "CP99999", "ISO-8859-1", "", "Shift_JIS")
LABELLED = ("utf-8", "utf-8", "utf-8", "windows-1251", "cp99999", "iso-8859-1", "", "shift_jis")
HEADS = ('<?xml version="1.0" encoding="koi8-r"?>', "<html><meta charset=big5>", '<meta http-equiv=x content="text/html; charset=windows-1250">', "<?xml encoding='utf-8'?>", "plain", "<meta charset=nonsense>", "<?XML encoding = 'gbk' ?>")
DECLARED = ("koi8-r", "big5", "windows-1250", None, None, None, "gbk")


def _word(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def charset_rules(spark, sf):
    def run(labels: pd.Series) -> pd.Series:
        return labels.map(charset.normalize)

    def sniffed(heads: pd.Series) -> pd.Series:
        return heads.map(lambda h: charset.declared(h.encode()))

    return _rows(spark, sf).select("k", F.pandas_udf(run, "string")(_pick(F.col("k"), *LABELS)).alias("label"), F.pandas_udf(sniffed, "string")(_pick(F.col("k"), *HEADS)).alias("declared"))


def identity_bytes(spark, sf):
    """Equal types give the stored bytes, unless another charset is asked for."""

    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        out = ("", "windows-1252", "utf-16le")
        return pd.Series([len(converted(t.encode("cp1252", "replace"), "text/html", "text/html", "windows-1252", out[k % 3])) for t, k in zip(texts, keys, strict=True)])

    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^a-z]", "").alias("t"))
    return docs.select("doc_id", F.pandas_udf(run, "long")("t", "doc_id").alias("n_bytes"))


def reading_order_types(spark, sf):
    """The reading order as stored, as plain text, in another charset, and both."""
    parsed = reader.parse_books(_files(spark, sf, _epub))
    out = None
    for name, mime, label in (("stored", None, None), ("plain", "text/plain", None), ("wide", None, "utf-16le"), ("both", "text/plain", "iso-8859-1")):
        size = F.octet_length("data").cast("long")
        rows = reader.reading_order_as(parsed, mime, label).select(F.col("book_id").cast("long").alias("book_id"), F.lit(name).alias("kind"), size.alias("n_bytes"), F.sha2(F.decode("data", "ISO-8859-1"), 256).alias("sha256") if name == "both" else F.lit(None).cast("string").alias("sha256"))
        out = rows if out is None else out.union(rows)
    return out


_PAGES = "SELECT conv_id, turn, text, '<html><head><title>t</title></head><body><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></body></html>' AS page FROM conversations WHERE role <> 'system'"
READING = f"""SELECT conv_id AS book_id, 'stored' AS kind, CAST(sum(strlen(page)) AS BIGINT) AS n_bytes, CAST(NULL AS VARCHAR) AS sha256 FROM ({_PAGES}) GROUP BY conv_id
UNION ALL SELECT conv_id, 'plain', CAST(sum(strlen(text)) AS BIGINT), NULL FROM ({_PAGES}) GROUP BY conv_id
UNION ALL SELECT conv_id, 'wide', CAST(sum(2 * length(page) + 2) AS BIGINT), NULL FROM ({_PAGES}) GROUP BY conv_id
UNION ALL SELECT conv_id, 'both', CAST(sum(length(text)) AS BIGINT), sha256(string_agg(text, '' ORDER BY turn)) FROM ({_PAGES}) GROUP BY conv_id"""

# fingerprints that are close


TURNED = (0, 1, 3, 7 << 10, 15 << 20, 1 << 59, 5, 7)


def close_fingerprints(spark, sf):
    """Pairs of made fingerprints that differ in three bits or fewer: eight around each of many, with up to four bits turned."""
    group = F.md5(F.floor(F.col("k") / 8).cast("string"))
    base = F.conv(F.substring(group, 1, 15), 16, 10).cast("long")
    marks = _rows(spark, sf).select(F.col("k").alias("doc_id"), base.bitwiseXOR(F.get(F.lit(list(TURNED)), F.col("k") % 8)).alias("simhash"))
    return dedup.simhash_pairs(marks).select("a", "b", "distance")


def hamming_rows(spark, sf):
    k = F.col("k").cast("long")
    return _rows(spark, sf).select("k", hamming(k * 48271 % 1_048_576, k * 16807 % 1_048_576).cast("long").alias("distance"))


_MARKS = f"""SELECT min(k) AS doc_id, m FROM (SELECT p_partkey AS k, xor(CAST('0x' || substr(md5(CAST(p_partkey // 8 AS VARCHAR)), 1, 15) AS BIGINT), [{", ".join(f"{t}::BIGINT" for t in TURNED)}][p_partkey % 8 + 1]) AS m FROM part) GROUP BY m"""
_OVER_TEXTS = lambda sql: sql.replace("FROM documents", f"FROM (SELECT book_id AS doc_id, text FROM ({TEXT_SQL}))")
_HEAD = "left(text, CAST(list_max(list_filter(range(0, {0} + 1), lambda i: strlen(left(text, i)) <= {0})) AS BIGINT))"

QUERIES = {
    "resolve_path": (resolve_path, f"SELECT k, CASE k % 4 WHEN 0 THEN 'O' || k % 9 || '/a.x' WHEN 1 THEN 'a.x' WHEN 2 THEN 'O' || k % 9 || '/a.x' ELSE 'O' || k % 9 || '/c/a.x' END AS path FROM ({PART})"),
    "image_media": (image_media, f"SELECT k, {_word(['image/jpeg', 'image/png', 'application/octet-stream', 'image/gif', 'image/svg+xml', 'image/svg+xml', 'application/octet-stream', 'application/octet-stream'])}[k % 8 + 1] AS media_type FROM ({PART})"),
    "split_values": (split_values, f"SELECT k, p_type || '|' || p_brand || '|' || replace(p_name, ' ', '|') AS parts FROM ({PART})"),
    "author_names": (author_names, f"SELECT k, upper(p_brand[1]) || lower(p_brand[2:]) || '|Smith & Co' AS authors FROM ({PART})"),
    "squashed": (squashed, f"SELECT k, p_type || ' ' || p_name AS text FROM ({PART})"),
    "topic_paths": (topic_paths, f"SELECT k, CASE k % 6 WHEN 0 THEN '/a' || k || '.htm' WHEN 1 THEN '/b.htm' WHEN 5 THEN '/c.htm' END AS path FROM ({PART})"),
    "help_media": (help_media, f"SELECT k, {_word(['text/html', 'text/html', 'text/css', 'image/png', 'image/jpeg', 'image/gif', 'application/octet-stream', 'application/octet-stream'])}[k % 8 + 1] AS media_type FROM ({PART})"),
    "publishers": (publishers, f"SELECT k, CASE WHEN k % 4 = 3 THEN 'Press: ' ELSE '' END || p_brand AS publisher FROM ({PART})"),
    "file_names": (file_names, f"SELECT k, CASE WHEN k % 5 = 0 THEN 'image' ELSE replace(p_type, ' ', '_') || {_word(['_é.png', '_.png', '_a-b.c'])}[k % 3 + 1] END AS name FROM ({PART})"),
    "palm_times": (palm_times, f"SELECT k, CASE WHEN k % 4 > 0 THEN strftime(make_timestamp(CAST(k AS BIGINT) * 86399 * 1000000), '%Y-%m-%d %H:%M:%S') END AS moment FROM ({PART})"),
    "identifier_lookup": (identifier_lookup, f"SELECT k, CASE WHEN k % 2 = 0 THEN '' ELSE 'b' END || k AS isbn, CAST(NULL AS VARCHAR) AS doi FROM ({PART})"),
    "isbn_validate": (isbn_validate, f"SELECT key, isbn, CAST(coalesce(length(isbn), 0) AS BIGINT) AS kind, isbn IS NOT NULL AS valid FROM (SELECT key, CASE WHEN key % 7 = 0 OR code <> 0 THEN NULL WHEN key % 3 = 1 THEN isbn10 ELSE isbn13 END AS isbn FROM {CHECKED})"),
    "isbn_find": (isbn_find, f"SELECT key, CASE WHEN code = 0 THEN isbn13 ELSE '' END AS isbns FROM {CHECKED}"),
    "isbn_declared": (isbn_declared, f"SELECT key, CASE WHEN code = 0 THEN isbn10 END AS digits, CASE WHEN code = 0 THEN isbn13 END AS declared FROM {CHECKED}"),
    "head_capture": (head_capture, f"SELECT book_id, {_HEAD.format(200)} AS head FROM ({TEXT_SQL})"),
    "scan_all": (scan_all, f"SELECT book_id, sha256(text) AS sha256, {_HEAD.format(100)} AS head, CAST(length(text) AS BIGINT) AS n_chars FROM ({TEXT_SQL})"),
    "scan_fingerprints": (scan_fingerprints, f"SELECT t.book_id, sha256(t.text) AS sha256, m.simhash, f.value AS first_minimum FROM ({TEXT_SQL}) t JOIN ({_OVER_TEXTS(SIMHASH_SQL)} SELECT * FROM marks) m ON m.doc_id = t.book_id JOIN ({_OVER_TEXTS(MIN_SQL)} SELECT * FROM minhashes WHERE place = 0) f ON f.doc_id = t.book_id"),
    "fallback_isbn": (fallback_isbn, _SCAN.format(_NAMED)),
    "fallback_isbn_limited": (fallback_isbn_limited, _SCAN.format(f"SELECT * FROM ({_LIMITED}) WHERE n <= 3")),
    "id_lookup": (id_lookup, f"{FIRST_SQL} SELECT book_id, id, pos FROM f WHERE pos % 3 = 0"),
    "resource_lookup": (resource_lookup, f"{FIRST_SQL} SELECT DISTINCT f.book_id, f.id, f.pos FROM f JOIN (SELECT DISTINCT book_id, CASE WHEN href = '' THEN '.' ELSE href_key END AS href_key FROM f WHERE pos % 3 = 0) w USING (book_id, href_key) WHERE f.r = 1"),
    "id_collisions": (id_collisions, f"{_FREE} SELECT book_id, pos, href_key, CASE WHEN seen > 1 THEN id || '__dup' || n ELSE id END AS id FROM f"),
    "alias_rows": (alias_rows, f"WITH c AS (SELECT book_id, pos, 'p' || pos AS id, row_number() OVER w AS r, first_value(pos) OVER w AS resource_pos FROM ({_COLLIDING}) WINDOW w AS (PARTITION BY book_id, href_key ORDER BY pos)) SELECT book_id, id, resource_pos FROM c WHERE r > 1"),
    "cover_alias": (cover_alias, f"""{_FREE}, b AS (SELECT book_id, max(pos) AS last, count(*) FILTER (WHERE id = 'i1') AS n1 FROM c GROUP BY book_id), d AS (SELECT book_id, count(*) AS n FROM f WHERE id = 'i1' AND seen > 1 GROUP BY book_id),
      h AS (SELECT book_id, pos, CASE WHEN seen > 1 THEN id || '__dup' || n ELSE id END AS id FROM f WHERE href_key = 'f3' AND CAST(book_id AS INT) % 2 = 0)
      SELECT book_id, coalesce(h.pos, last + 1) AS pos, CASE WHEN h.pos IS NOT NULL THEN h.id WHEN n1 = 0 THEN 'i1' ELSE 'i1__dup' || coalesce(d.n, 0) + 1 END AS id, h.pos IS NULL AS is_new FROM b LEFT JOIN d USING (book_id) LEFT JOIN h USING (book_id)"""),
    "fb3_body_text": (fb3_body_text, "SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[&<>]', '+', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) || chr(10) || 'a' || chr(10) || 'b') AS sha256 FROM documents"),
    "conversion_graph": (conversion_graph, "SELECT graph, source, target, CAST(steps AS BIGINT) AS steps FROM (VALUES ('own', 'a/a', 'c/c', 2), ('own', 'a/z', 'c/c', 2), ('own', 'c/c', 'a/a', -1), ('own', 'x/x', 'X/X;y', 0), ('own', 'a/a', 'e/e', 2)) t(graph, source, target, steps) UNION ALL SELECT 'default', unnest([" + ", ".join(f"'{a}'" for a in sorted({a for a, _ in default_registry().steps})) + "]), 'text/plain', 1::BIGINT"),
    "custom_conversion": (custom_conversion, "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN sha256('[' || upper(regexp_replace(text, '[^a-z ]', '', 'g')) || ']') END AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'NO_TRANSFORMER' END AS error FROM documents"),
    "charset_rules": (charset_rules, f"SELECT k, {_word(LABELLED)}[k % {len(LABELS)} + 1] AS label, {_word(DECLARED)}[k % {len(HEADS)} + 1] AS declared FROM ({PART})"),
    "identity_bytes": (identity_bytes, "SELECT doc_id, CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) * CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END + CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 0 END AS BIGINT) AS n_bytes FROM documents"),
    "reading_order_types": (reading_order_types, READING),
    "close_fingerprints": (close_fingerprints, f"SELECT x.doc_id AS a, y.doc_id AS b, CAST(bit_count(xor(x.m, y.m)) AS BIGINT) AS distance FROM ({_MARKS}) x JOIN ({_MARKS}) y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.m, y.m)) <= 3"),
    "hamming_rows": (hamming_rows, f"SELECT k, CAST(bit_count(xor(CAST(k * 48271 % 1048576 AS BIGINT), CAST(k * 16807 % 1048576 AS BIGINT))) AS BIGINT) AS distance FROM ({PART})"),
}
