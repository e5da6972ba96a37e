"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one for each block of text. A line weighs as many
characters as it has outside links, on every page alike; markup only lowers
that: a line that it says is no article text (menus, forms, notices, adverts,
comments ...) is left out, one beside a page's article elements weighs a part.
Weights are summed over sliding windows of lines; text begins where the sum
surges over a threshold and ends where it dives, and every stretch between is
kept. In an article element a short line of plain text is no dive, a run of
links is; windows end at the element's edges. A heavy stretch outside wins over
light article elements, such as the cards of other stories.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import bounded, part, pieces

WINDOW = 3
#: Sum of a window at which text begins, and at or below which it ends.
SURGE, DIVE = 80, 12
#: What a line beside the page's article elements weighs of its text.
BESIDE = 0.25

# Elements by what they do.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "noembed", "noframes", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "head"}
ARTICLE = {"article", "main"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "span", "p", "blockquote", "header", "a"} | ASIDE | ARTICLE
# Words in class, id or role that mark what is no article text.
OUTSIDE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo",
    "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notification", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget",
}
# Of these, the words for readers' comments.
COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}
# Elements that hold or head an article.
HEADED = {"article", "main", "h1"}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
#: Words that, beside one of these in the same token, say that something is there or not, as in has-sidebar.
STATE = {"has", "have", "no", "not", "with", "without", "hide", "show", "open", "closed", "enabled", "disabled"}

#: An attribute: its name and, if it has one, its value; the next one begins after the value.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")


def _tag_end(page: str, at: int) -> int:
    """The place after the > of a tag; a > within a quoted value does not count, a quote that stays open does not either."""
    while True:
        at = _PLAIN.match(page, at).end()
        if at >= len(page):
            return len(page)
        if page[at] == ">":
            return at + 1
        close = page.find(page[at], at + 1)
        at = at + 1 if close < 0 else close + 1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, ""), raw elements and comments left out."""
    at, size = 0, len(page)
    lowered = None
    while at < size:
        open_ = page.find("<", at)
        if open_ < 0:
            yield "text", page[at:], ""
            return
        if open_ > at:
            yield "text", page[at:open_], ""
        if page.startswith("<!--", open_):
            close = page.find("-->", open_ + 4)
            at = size if close < 0 else close + 3
        elif page.startswith(("<!", "<?"), open_):
            close = page.find(">", open_)
            at = size if close < 0 else close + 1
        elif found := _NAME.match(page, open_ + 1):
            name, at = found[0].lower(), _tag_end(page, found.end())
            if name[0] == "/":
                yield "end", name[1:], ""
                continue
            mark = page[found.end() : at]
            if name in RAW and not mark.endswith("/>"):
                lowered = page.lower() if lowered is None else lowered
                if len(lowered) != size:  # a few characters change their number when lowered
                    lowered = "".join(c if len(low := c.lower()) != 1 else low for c in page)
                close = lowered.find("</" + name, at)
                at = size if close < 0 else _tag_end(page, close + 2)
                continue
            yield "start", name, mark
        else:
            yield "text", "<", ""
            at = open_ + 1


def _outside(name: str, mark: str, article: bool) -> int:
    """1 if an element is no article text; 2 if a class, id or label says so, 3 if only a word of a compound one does; else 0.

    An article's own header is article text. An article element is never a comment by its class alone.
    """
    if name in ASIDE:
        return 1
    found: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(mark):
        if value[:1] in ("'", '"') and value[-1:] == value[0] and len(value) > 1:
            value = value[1:-1]
        found.setdefault(key.lower(), html.unescape(value).lower())  # the first of a name holds
    if "hidden" in found or _NONE.search(found.get("style", "")):
        return 1
    ruled = OUTSIDE - {"header"} if article else OUTSIDE
    out = 0
    for key in ("class", "id", "role", "aria-label"):
        value = found.get(key, "")
        for token in value.split() if key != "aria-label" else [value.strip()]:
            if token in ruled:
                if token in COMMENTS and name not in ARTICLE:
                    return 1
                out = 2
            words = ["", *_WORD.findall(token), ""]
            if any(w in ruled and words[i] not in STATE and words[i + 2] not in STATE for i, w in enumerate(words[1:-1])):
                out = out or 3
    return out


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, outside, in an article) of each line that has text.

    An element that a class, id or label rules out is kept if over half of the text is in it: nothing that
    holds the bulk of a page is a sidebar. If the whole of a name says so, it must also hold an article,
    main or h1 element or be one.
    """
    out: list[tuple[str, int, int, bool, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name; 1: outside, 2: article, 4: link; the number of a doubtful element
    linked = outside = article = links = doubt = 0
    above, headed = [0], [True]  # for each doubtful element: the one around it, whether it may be kept

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, min(linked, len(text)), outside, bool(article), doubt))
        parts.clear()
        linked = 0

    for kind, name, mark in tokens(page):
        if kind == "text":
            text = html.unescape(name)
            parts.append(text)
            linked += len(text.strip()) if links else 0
            continue
        if name not in INLINE:
            flush()
        if kind == "start":
            if name in HEADED:
                d = doubt
                while d and not headed[d]:
                    headed[d] = True
                    d = above[d]
            if name in VOID or name not in CONTAINERS or mark.endswith("/>"):
                continue
            state = 4 if name == "a" else 0
            number = 0
            said = 1 if name == "header" and not article else _outside(name, mark, bool(article))
            if said and name in INLINE:
                flush()
            if said == 1:
                state |= 1
            elif said:
                above.append(doubt)
                headed.append(said == 3 or name in HEADED)
                doubt = number = len(above) - 1
            if name in ARTICLE and said != 1:
                state |= 2
                # a notice that was never closed does not swallow the article
                if outside and all(n == "div" for n, s, _ in stack if s & 1):
                    stack = [(n, s & ~1, d) for n, s, d in stack]
                    outside = 0
                if doubt and all(n == "div" for n, _, d in stack if d):
                    stack = [(n, s, 0) for n, s, _ in stack]
                    doubt = number
                    if number:
                        above[number] = 0
            stack.append((name, state, number))
            outside, article, links = outside + (state & 1), article + (state >> 1 & 1), links + (state >> 2)
        elif any(n == name for n, _, _ in reversed(stack)):
            while True:
                last, state, number = stack.pop()
                if (state & 1 or number) and last in INLINE:
                    flush()
                doubt = above[number] if number else doubt
                outside, article, links = outside - (state & 1), article - (state >> 1 & 1), links - (state >> 2)
                if last == name:
                    break
    flush()
    held = [0] * len(above)
    for text, k, o, _, d in out:
        held[d] += 0 if o else len(text) - k
    for d in range(len(above) - 1, 0, -1):
        held[above[d]] += held[d]
    ruled = [False] * len(above)
    for d in range(1, len(above)):
        ruled[d] = ruled[above[d]] or not headed[d] or 2 * held[d] <= held[0]
    return [(text, k, bool(o) or ruled[d], a) for text, k, o, a, d in out]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> str:
    """The article's text, its blocks joined by one space; empty if there is none."""
    shown = [x for x in lines(page or "") if not x[2]]  # windows run over the lines that the markup does not rule out
    run = [len(t) - k for t, k, _, _ in shown]
    held = sum(r for r, x in zip(run, shown, strict=True) if x[3])
    if 2 * held > sum(run):  # the article elements hold the bulk
        run = [r if x[3] else int(BESIDE * r) for r, x in zip(run, shown, strict=True)]
    if not any(run):
        return ""
    edges = [i for i in range(len(shown)) if not i or shown[i][3] != shown[i - 1][3]] + [len(shown)]
    stretches: list[tuple[int, int]] = []
    light: list[tuple[int, int]] = []  # article elements with some text and no surge
    best = (0, 0, 0)
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        begin, known = None, len(stretches)
        for i in range(first, last):
            stop = min(last, i + window)
            total = sum(run[i:stop])
            if total > best[0]:
                best = total, i, stop
            inside = shown[i][3]
            if begin is None and run[i] and total > surge:
                # an article begins with its first line, or after a run of links; elsewhere the surge shows it
                begin, floor = i, stretches[-1][1] if len(stretches) > known else first
                while inside and begin > floor and (begin - floor < window or any(run[begin - window : begin])):
                    begin -= 1
            elif begin is not None and total <= dive and not (inside and (any(run[i:stop]) or stop - i < window)):
                stretches.append((begin, i))  # in an article, a dive is a window of nothing but links
                begin = None
        if begin is not None:
            stretches.append((begin, last))
        if shown[first][3] and len(stretches) == known and any(run[first:last]):
            light.append((first, last))
    # a page of a few short lines: the heaviest window
    kept = stretches or [best[1:]]
    if stretches and shown[max(kept, key=lambda x: sum(run[x[0] : x[1]]))[0]][3]:
        kept = sorted(kept + light)  # an article element holds the heaviest stretch: then shorter ones stay too
    return " ".join(shown[i][0] for a, b in kept for i in range(a, b) if shown[i][3] or run[i])


def _extract(batches: Iterator[pa.RecordBatch], window: int, surge: int, dive: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [main_text(page, window, surge, dive) for page in batch.column("html").to_pylist()]
        sizes = pa.array(list(map(len, texts)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), sizes], ["row", "text", "n_chars"])


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> DataFrame:
    """pages(html, ...) -> (row, text, n_chars), a row for each page; row is the page without its html.

    Null, empty and broken pages give what text they have, at least the empty one.
    """
    rest = [c for c in pages.columns if c != "html"]
    rows = bounded(pages).select(F.struct(*rest).alias("row"), "html")
    return rows.mapInArrow(part(_extract, window=window, surge=surge, dive=dive), f"row {dict(rows.dtypes)['row']}, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("row.page_id", "row.url", "text", "n_chars")


# Only for pages whose menus, adverts, notes and footers are elements without others of their kind inside, as those of the tables are.
OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>|<aside>.*?</aside>', ' ', 'g') AS c FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(c, '(?s)<[^>]*>', ' ', 'g') AS t FROM cut
), plain AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(t, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM bare
), spaced AS (
  SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM plain
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM spaced
"""
