import numpy as np
import pytest
from codexa.functions import charset, fingerprint, isbn, markup, tokens
from codexa.functions import strings as st
from codexa.functions.conversion import DEFAULT, NoConversion, Registry, convert, converted
from pyspark.sql import functions as F


def hashes(values):
    """FNV-1a of each value."""
    sizes = np.array([len(v) for v in values], np.int64)
    return fingerprint.fnv1a(np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes)


def values(spark, rows, kind, make):
    """make(column) over rows, in order."""
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r.x for r in table.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_media_types(spark):
    rows = [" Text/HTML ; x=1", "IMAGE/JPG", "application/atom+xml", "application/x-ereader-pml", "", None, "application/octet-stream", "\u00a0a/b"]
    assert values(spark, rows, "string", st.mime_normalize) == ["text/html", "image/jpg", "application/atom+xml", "application/x-ereader-pml", "", None, "application/octet-stream", "a/b"]
    assert values(spark, rows, "string", st.mime_extension)[1:7] == ["jpg", None, None, None, None, "bin"]
    assert values(spark, rows, "string", st.is_text)[:5] == [True, False, True, True, False]
    assert values(spark, rows, "string", st.can_convert)[:5] == [True, False, False, True, False]
    assert values(spark, [b"\xff\xd8\xff\0", b"\x89PNG\r\n\x1a\n", b"GIF8", b"  <svg>", b"zz"], "binary", st.image_type) == ["image/jpeg", "image/png", "image/gif", "image/svg+xml", "application/octet-stream"]
    assert values(spark, ["/a.HTM", "x.weird", "none"], "string", st.help_type) == ["text/html", "application/octet-stream", "application/octet-stream"]


def test_hrefs(spark):
    assert values(spark, ["a/b/../c?x#y", "/../x//y/.", "", "../a", "..", "a/..", "/"], "string", st.clean_href) == ["a/c", "/x/y", ".", "../a", "..", ".", "/"]
    assert values(spark, ["i/x.png#f", "../i.png"], "string", lambda c: st.resolve_href(F.lit("OEBPS/t/a.opf"), c)) == ["OEBPS/t/i/x.png", "OEBPS/i.png"]
    assert values(spark, ["a.htm;x#y", "http://x", "javascript:1", "/b", ""], "string", st.topic_path) == ["/a.htm", None, None, "/b", None]
    assert values(spark, ["a b/ü.png", ""], "string", st.file_name) == ["a_b_ü.png", "image"]


def test_identifiers_agree_with_the_readers_rule(spark):
    from codexa.sources.model import split_identifier

    rows = ["isbn:1", "urn:uuid:a-b", "http://x/y", "calibre: 7", " plain ", "doi:10.1/2", "urn:", "urn::x", "1a:b", "", "HTTPS:x", "a b:c", "urn:ISBN:97", "x://", "foo:bar:baz"]
    assert [tuple(x) for x in values(spark, rows, "string", st.identifier)] == [split_identifier(r) for r in rows]
    assert [tuple(x) for x in values(spark, rows, "string", lambda c: st.identifier(c, F.lit("isbn-13")))] == [split_identifier(r, "isbn-13") for r in rows]
    ids = F.array(F.struct(F.lit("isbn").alias("scheme"), F.lit("").alias("value")), F.struct(F.lit("ISBN").alias("scheme"), F.lit("5").alias("value")))
    assert spark.range(1).select(st.find_identifier(ids, "Isbn").alias("x")).first().x == "5"


def test_lists(spark):
    assert values(spark, [["A; b;a", " B ;;c"]], "array<string>", st.split_subjects) == [["A", "b", "a", "B", "c"]]
    assert values(spark, [["A", "b", "a", "B", "c"], []], "array<string>", st.dedupe_subjects) == [["A", "b", "c"], []]
    assert values(spark, ["A and B, with C && D & E", "land"], "string", st.split_authors) == [["A", "B", "C & D", "E"], ["land"]]
    assert values(spark, ["a, b;c;"], "string", st.split_list) == [["a", "b", "c"]]
    assert values(spark, [" a \n b\u00a0 "], "string", st.squash) == ["a b"]
    assert values(spark, ["Publisher: X"], "string", st.clean_publisher) == ["X"]
    assert values(spark, [0, 2082844800], "long", st.palm_time)[0] is None


ISBNS = {
    "0-306-40615-2": "0306406152", "ISBN 978-0-306-40615-7": "9780306406157", "ISBN-13: 9780306406157": "9780306406157", "urn:isbn:0306406152": "0306406152", "isbn10:0306406152": "0306406152", "043942089x": "043942089X",
    "9780306406158": None, "0306406153": None, "X306406152": None, "9770306406157": None, "": None, "ISBN": None, "978 0 306 40615 7": "9780306406157", "٠٣٠٦٤٠٦١٥٢": "0306406152", "03064\u201006152": "0306406152", "0306406152 ok": None,
}


def test_isbn_columns_and_functions_agree(spark):
    assert values(spark, list(ISBNS), "string", isbn.normalize) == list(ISBNS.values()) == [isbn.normalized(s) for s in ISBNS]
    assert isbn.normalized("０３０６４０６１５２") == "0306406152" == values(spark, ["０３０６４０６１５２"], "string", isbn.normalize_exact)[0]
    cores = ["111111111", "123456789", "234567890", "876543210", "121212121", "123123123", "112112112", "111222333", "444555666", "111111234", "112211221", "306406152", "314159265", "012012012", "890123456", "100000000"]
    full = [c + "0" for c in cores]
    assert values(spark, full, "string", isbn.placeholder) == [isbn.placeholder_of(c) for c in full] == [1, 5, 2, 2, 3, 5, 3, 5, 3, 3, 4, 0, 5, 3, 2, 3]
    good = ["0306406152", "043942089X", "9780306406157", "9791090636071"]
    assert values(spark, good, "string", isbn.to13) == ["9780306406157", "9780439420891", "9780306406157", "9791090636071"] == [isbn.as13(g) for g in good]
    assert values(spark, good, "string", isbn.to10) == ["0306406152", "043942089X", "0306406152", None]
    assert values(spark, [*good, None, "x"], "string", isbn.kind) == [10, 10, 13, 13, 0, 0]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("see ISBN 978-0-306-40615-7, and 0-306-40615-2; ISBN: 0 439 42089 X.", ["9780306406157", "043942089X"]),
        ("0306406152 9780306406157", ["0306406152"]),
        ("10306406152 03064061521", []),
        ("1SBN-10: 0306406152", ["0306406152"]),
        ("123456789X 1111111111", []),
        ("ISBN０３０６４０６１５２", ["0306406152"]),
        (None, []),
        ("", []),
    ],
)
def test_isbn_search(text, found):
    assert isbn.find(text) == found


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("Hello, World!", ["hello", "world"]),
        ("Straße ẞ ﬁne x\u00ady", ["strasse", "ss", "fine", "xy"]),
        ("co-\noperate co-operate co- \r\n  operate", ["cooperate", "co", "operate", "cooperate"]),
        ("a-\nb co-\n\nop co-\nOp co-\n1 co-", ["a", "b", "co", "op", "co", "op", "co", "1", "co"]),
        ("word-\nby-\nword", ["wordbyword"]),
        ("x" + "-\n" + " " * 2000 + "y ab-" + " " * 2000 + "\ncd", ["x", "y", "ab", "cd"]),
        ("½ a\u0301b \ufffd", ["1⁄2", "áb"]),
        (None, []),
        ("...", []),
    ],
)
def test_words(text, words):
    assert tokens.words(text) == words


def test_native_words_agree_on_plain_text(spark):
    rows = ["Hello, World! 12 ½", "Größe straße", "", "a_b c"]
    got = values(spark, rows, "string", tokens.native_words)
    assert [g for g, r in zip(got, rows, strict=True) if "½" not in r] == [tokens.words(r) for r in rows if "½" not in r]
    assert values(spark, rows, "string", lambda c: tokens.native_shingles(tokens.native_words(c), 2))[1:] == [["grösse strasse"], [], ["a b", "b c"]]
    assert tokens.shingles(["a", "b", "c"], 2) == ["a b", "b c"] and tokens.shingles(["a"], 5) == ["a"] and tokens.shingles([], 5) == []


def test_fingerprints(spark):
    assert int(hashes([b"hello"])[0]) == 0xA430D84680AABD0B
    text = " ".join(f"w{i * i % 97}" for i in range(400))
    h = hashes([s.encode() for s in tokens.shingles(tokens.words(text), 5)])
    plain = []
    for seed in fingerprint.seeds(8).tolist():
        best = 2**64 - 1
        for x in h.tolist():
            m = x ^ seed
            for factor in fingerprint.FMIX:
                m = (m ^ m >> 33) * factor % 2**64
            best = min(best, m ^ m >> 33)
        plain.append(best)
    got = values(spark, [text, "", None, text + " more words at the end here"], "string", lambda c: fingerprint.fingerprint(c, n=8))
    assert np.array(got[0].minhash, np.int64).view(np.uint64).tolist() == plain
    ones = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h.tolist()) > len(h))
    assert got[0].simhash % 2**64 == ones and got[1].minhash == [-1] * 8 and got[1].simhash == 0 and got[2].minhash is None
    pairs = spark.createDataFrame([([1, 2], [1, 3], 7, 4), ([], [], 0, -1), ([1], [1, 2], 1, 1)], "a array<long>, b array<long>, x long, y long")
    out = pairs.select(fingerprint.jaccard(F.col("a"), F.col("b")), fingerprint.hamming(F.col("x"), F.col("y")), fingerprint.similarity(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in out] == [(0.5, 2, 62 / 64), (1.0, 64, 0.0), (0.0, 0, 1.0)]


def test_estimate_is_near_the_exact_similarity():
    a = [f"w{i}" for i in range(300)]
    b = a[:200] + [f"v{i}" for i in range(100)]
    sets = [set(tokens.shingles(x, 3)) for x in (a, b)]
    h = [hashes([s.encode() for s in x]) for x in sets]
    m = fingerprint.minhash_all(np.concatenate(h), np.array([len(x) for x in sets]), n=256)
    assert abs((m[0] == m[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) <= 0.15


@pytest.mark.parametrize(
    ("step", "source", "text"),
    [
        (markup.html_to_text, "<html><head><title>x</title></head><body><h1>A &amp; B</h1> <p>one<br>two<b>three</b></p>\n<p>&nbsp;</p><noscript>no</noscript><li>q</body>", "A & B\none\ntwothree\nq"),
        (markup.html_to_text, "<head><title>t</title><p>begun</p>", "begun"),
        (markup.html_to_text, "a<script>if (a<b) '</p>'</script>b<!-- <p> -->c", "abc"),
        (markup.html_to_text, "", ""),
        (markup.fb2_to_text, "<body><title><p>T</p></title><p>a &amp; &foo; b </p><empty-line/><p><![CDATA[<x>]]></p><binary>zz</binary></body>", "T\n\na & &foo; b \n\n<x>"),
        (markup.fb2_to_text, "<f:p>one</f:p><p>two</p> 1 < 2", "one\ntwo\n1 < 2"),
        (markup.fb3_to_text, "<p>One<br/>Two</p><ul><li>Three</li></ul>", "One\nTwo\nThree"),
        (markup.pml_to_text, '\\pHello \\iworld\\i\\C1="Title"x\\a169\\U0041\\\\ \\vnote\\v end\\xChap\\x \\Fn="a"n\\Fn \\Q="z"r', "Hello world\n\nTitle\n\nx©A\\  end\n\nChap\n\n n r"),
        (markup.pml_to_text, "a\r\nb\\aqqq\\", "a\nb\\aqqq\\"),
        (markup.lrf_to_text, "a\ufffcb", "ab"),
    ],
)
def test_markup(step, source, text):
    assert step(source) == text


def test_references_without_a_semicolon():
    page = "<h1>A &amp; B&amp</h1>&ampx; &#38;&#38 &nosuch;<title>&quot;&quot</title>"
    assert markup.html_to_text(page) == 'A & B&\n&x; && &nosuch;""'
    assert markup.html_to_text(page, closed=True) == 'A & B&amp\n&ampx; &&#38 &nosuch;"&quot'


def test_charsets():
    assert charset.declared(b'<?xml version="1.0" encoding="windows-1251"?>') == "windows-1251" and charset.declared(b"<meta charset=utf8>") is None and charset.declared(b"<meta charset=nope>") is None
    assert charset.declared(b"\xff\xfe<\0") == "utf-16le" and charset.declared(b"\0<") == "utf-16be" and charset.normalize("CP1251") == "windows-1251" and charset.normalize("cp9") == "cp9"
    assert charset.decode(b"\x93", "iso-8859-1") == "\u201c" and charset.decode("ж".encode("utf-16")) == "ж" and charset.decode(b"\xff") == "\ufffd"
    assert charset.encode("ж", "windows-1251") == b"\xe6" and charset.encode("a", "utf-16le") == b"\xff\xfea\0" and charset.encode("a", "") == b"a"
    with pytest.raises(LookupError):
        charset.encode("a", "nope")


def test_conversion_graph(spark):
    upper = Registry().register("a/x", "b/y", str.upper).register("b/y", "text/plain", lambda s: s + "!").alias("a/x", "c/z")
    assert converted(b"hi", "c/z; q=1", "text/plain", registry=upper) == b"HI!" and upper.path("a/x", "a/x") == [] and upper.find("b/y", "TEXT/plain")("q") == "q!"
    assert converted(b"\xe6", "text/plain", "text/plain", "windows-1251") == b"\xe6" and converted(b"\xe6", "text/plain", "text/plain", "windows-1251", "utf-8") == "ж".encode()
    with pytest.raises(NoConversion):
        converted(b"", "image/png", "text/plain")
    rows = spark.createDataFrame([(b"<p>a", "text/html"), (b"x", "image/png"), (None, "text/plain")], "d binary, m string")
    assert [(None if r.c.data is None else bytes(r.c.data), r.c.error) for r in rows.select(convert(F.col("d"), F.col("m")).alias("c")).collect()] == [(b"a", None), (None, "NO_TRANSFORMER"), (b"", None)]
    assert len(DEFAULT.steps) == 8


def test_sql_names(spark):
    from codexa.functions.sql import register

    assert "find_isbns" in register(spark)
    row = spark.sql("SELECT find_isbns('ISBN 0306406152') i, html_to_text('<p>a') h, simhash('') s, size(minhash('a b')) n, isbn_normalize(null) z, word_tokens('A b') w").first()
    assert (row.i, row.h, row.s, row.n, row.z, row.w) == (["0306406152"], "a", 0, 128, None, ["a", "b"])


def test_what_a_document_declares():
    from codexa.functions.charset import declared

    for head, label in [
        (b'<?xml version="1.0" encoding="windows-1251"?>', "windows-1251"), (b"<?XML version='1.0'\n encoding = 'koi8-r' ?><a>", "koi8-r"), (b"<html><META CHARSET=big5><p>", "big5"),
        (b'<meta http-equiv="Content-Type" content="text/html; charset=windows-1252"/>', "windows-1252"), (b'<meta name=x content="a"><meta charset = "shift_jis" />', "shift_jis"),
        (b"<meta charset=utf-8>", None), (b"<metadata charset=big5>", None), (b"<meta charset=foo>", None), (b"", None), (b"<meta", None), (b"<meta content=\"a; charset='gbk'\">", "gbk"),
        (b"<meta charset=gbk/>", "gbk"), (b"\xfe\xff\0<", "utf-16be"), (b"<\0?\0", "utf-16le"),
    ]:
        assert declared(head) == label, head


def test_stretches_hash_like_the_shingles_they_stand_for():
    texts = ["", None, "one", "a b c", "Straße größer İstanbul ﬁnal x² ﷺ end of it all", "the cat sat on the mat the cat sat on the mat", "-- ..", "e\u0301 " * 9]
    for k in (1, 2, 5):
        h, counts = fingerprint._hashed(texts, k)
        plain = [[s.encode() for s in tokens.shingles(tokens.words(t), k)] for t in texts]
        assert counts.tolist() == [len(p) for p in plain]
        assert h.tolist() == hashes([s for p in plain for s in p]).tolist()
