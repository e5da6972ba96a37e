import os
import re

import pytest
from codexa.llm.html_extract import OP9_SQL, extract, main_text, op9_html

LONG, MORE = "word " * 60, "other " * 50
PAGE = f"""<html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>x";</script></head><body><nav><a href=x>Home</a></nav><!-- <p>no</p> -->
<div class="ad">Buy</div><article><h1>Big &amp; new</h1><p>{LONG}<p><b>short.<br>line</b><aside>See also</aside><form><p>Your name</p></form><p>{MORE}</p>
<section id="comments"><p>{LONG}</p></section></article><footer>&copy; us</footer></body></html>"""
BARE = f'<body><div id="top-menu"><a>One</a> <a>Two</a></div><div><h1>Big &amp; new</h1><p>{LONG}</p><p>short.</p><p>{MORE}</p></div><div class="comment-list">{LONG}</div><ul><li><a>link</a></li></ul></body>'


def squashed(*parts):
    return " ".join(" ".join(parts).split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, squashed("Big & new", LONG, "short. line", MORE)),
        (PAGE.replace("article", "main"), squashed("Big & new", LONG, "short. line", MORE)),
        (PAGE[: PAGE.index("</article>")], squashed("Big & new", LONG, "short. line", MORE)),
        (BARE, squashed("Big & new", LONG, "short.", MORE)),
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<nav>only a menu</nav>", ""),
        ("plain", "plain"),
        ("a < b &am c", "a < b &am c"),
        ("<article><p>x&nbsp; y\n z</p><p hidden>no</p><script>s", "x y z"),
        ('<div class="ad">buy <article>kept</article>', "kept"),
        ("<article>" + "<div>" * 5000 + "deep", "deep"),
        ('<div class="site-header">Site</div><article><header><h1>Head</h1></header><div class="entry-header">By me</div><p>x</article>', "Head By me x"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_extract_keeps_a_row_for_each_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, None), (2, None, None, None)], "page_id int, url string, html string, text string")
    got = extract(pages).collect()
    assert len(got) == 3 and {r.n_chars for r in got} == {0, len(main_text(PAGE))} and {r.row.text for r in got} == {"t", None}


CARDS = '<article><h3>Teaser</h3></article>'
LINKS = "<ul>" + "".join(f"<li><a href=x>Read story number {i} here</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div id=content><h1>Big</h1><p>{LONG}</p><p>{MORE}</p></div>{CARDS * 2}</body>", squashed("Big", LONG, MORE)),
        (f"<body>{CARDS}<div id=content><p>{LONG}</p><p>{MORE}</p></div></body>", squashed(LONG, MORE)),
        (f"<article><h2><a href=x>Head</a></h2><p>{LONG}</p><p>no.</p><p>so.</p><p>go.</p><p>{MORE}</p>{LINKS}</article>", squashed("Head", LONG, "no. so. go.", MORE)),
        (f"<p>Tagline</p><article><p>{LONG}</p></article><p>Made by hand</p><article><p>Short note</p></article>", squashed(LONG, "Short note")),
    ],
)
def test_stretches_compete_in_and_out_of_an_article_element(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><p>{LONG}</p><p><a href="/hidden-valley" title="The hidden truth">{MORE}</a> is it</p></article>', squashed(LONG, MORE, "is it")),
        (f'<article><p>{LONG}</p><div title="The hidden truth" data-style="display:none" aria-hidden="false">{MORE}</div></article>', squashed(LONG, MORE)),
        (f'<article><p>{LONG}</p><p><a href="/q?id=search">{MORE}</a> is it</p></article>', squashed(LONG, MORE, "is it")),
        (f'<div class="page has-sidebar"><p>{LONG}</p></div><div class=no-sidebar><p>{MORE}</p></div>', squashed(LONG, MORE)),
        (f'<article><p>{LONG}</p><div class="col content-with-sidebar">{MORE}</div></article>', squashed(LONG, MORE)),
        (f'<div id="layout_sidebar_left"><p>{LONG}</p><div class="comment-list">No</div><p>{MORE}</p></div><div class="sidebar">{LONG}</div>', squashed(LONG, MORE)),
        (f'<article><p>{LONG}</p><div class="x sidebar">{MORE}</div><div CLASS=share-bar>No</div><p HIDDEN>no</p><p style="color:red; DISPLAY : none">no</p></article>', squashed(LONG)),
        (f'<div class="cookie-notice">Ok <article><p>{LONG}</p></article>', squashed(LONG)),
    ],
)
def test_attributes_are_read_one_by_one(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("kind", ['<div class="page has-sidebar">', '<section class="layout no-sidebar">', '<article class="post tag-search related">', '<div class="promo"><h1>T</h1>', '<body class="search"><main>'])
def test_no_class_of_a_wrapper_loses_the_article(kind):
    head = "T " if "<h1>" in kind else ""
    tail = {"<d": "</div>", "<s": "</section>", "<a": "</article>", "<b": "</main></body>"}[kind[:2]]
    page = f"<nav><a href=x>Home</a></nav>{kind}<p>{LONG}</p><p>{MORE}</p>{tail}<footer>us</footer>"
    assert main_text(page) == head + squashed(LONG, MORE)


@pytest.mark.parametrize("inner", ["<p>e<math><mi>x</mi><mo>=</mo><mn>2</mn></math> it</p>", "<svg><text>chart</text></svg>", "<object>shown</object>", "<ul><li>a<li>b<li>c<li>d</ul>", "<table><tr><td>1<td>2</table>", "<pre>code  x</pre>"])
def test_nothing_is_dropped_inside_an_article(inner):
    plain = re.sub("<[^>]*>", " ", inner)
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>")):
        got = main_text(f"{open_}<p>{LONG}</p>{inner}<p>{MORE}</p>{close}")
        assert "".join(got.split()) == "".join(f"{LONG}{plain}{MORE}".split())


def test_every_stretch_of_an_unmarked_page_stays():
    short = "small words here. " * 17
    page = f"<div><p>{LONG * 7}</p></div>{LINKS}<div><p>{short}</p></div>"
    assert main_text(page) == squashed(LONG * 7, short)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>"])
def test_surge_and_dive_decide_with_and_without_an_article_element(wrap):
    page = f"<nav><a>x</a></nav>{wrap.format(f'<p>Short.</p><p>{MORE}</p>{LINKS}<p>{LONG}</p>')}"
    plain = main_text(page)
    assert squashed(MORE) in plain and squashed(LONG) in plain and "Read story" not in plain
    results = {plain, main_text(page, surge=310), main_text(page, dive=305), main_text(page, window=1)}
    assert len(results) > 1 and main_text(page, surge=310) != plain


def test_query_equals_its_sql_and_empty_tables_give_none(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    got = sorted(map(tuple, op9_html(spark, sf).select("page_id", "url", "text", "n_chars").collect()))
    assert got == sorted(con.sql(f"SELECT page_id, url, text, n_chars FROM ({OP9_SQL})").fetchall()) and len(got) > 200
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op9_html(spark, str(tmp_path)).collect() == []


def test_a_page_of_a_megabyte_is_whole():
    text = main_text(f"<article>{f'<p>{LONG}</p>' * 4000}</article>")
    assert len(text) == 4000 * len(squashed(LONG)) + 3999
