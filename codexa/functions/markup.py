"""Markup to plain text: HTML, FictionBook 2 and 3 bodies, PML, and the LRF text flow.

Each converter is a plain function on a string, written as a fold over the
tokens that a regular expression finds; convert() in `conversion` runs them over
Arrow batches.
"""

from __future__ import annotations

import html
import re

# Elements that begin a new line, that hold no text of the book, and that may stand in a head.
HTML_BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
HTML_SKIPPED = frozenset(("script", "style", "noscript", "head"))
HTML_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
# Elements whose content is raw text, or text with character references only.
HTML_RAW = frozenset("iframe noembed noframes noscript script style xmp".split())
HTML_RCDATA = frozenset(("title", "textarea"))
FB2_BLOCKS = frozenset("p v subtitle text-author th td title stanza".split())
FB2_SKIPPED = frozenset(("binary", "stylesheet"))
FB3_BLOCKS = frozenset("p v subtitle text-author th td title stanza li".split())

_HTML = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']|=\s*"[^"]*"|=\s*'[^']*'|["'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_XML = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<!(?:[^\[>]|\[.*?\])*>|<(?P<end>/)?(?P<name>[A-Za-z_][\w.:-]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>""",
    re.S,
)
_ENTITY = re.compile(r"&(#[xX][0-9A-Fa-f]{1,62}|#[0-9]{1,62}|[A-Za-z][A-Za-z0-9]{0,62});")


def _closed(text: str) -> str:
    """Character references that end with a semicolon replaced, others left as they stand."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html.entities.html5 else m[0], text) if "&" in text else text


def html_to_text(page: str, closed: bool = False) -> str:
    """Text of an HTML page, a line for each block that has text.

    closed: only character references that end with a semicolon are replaced; else, as browsers do it, also the old
    names without one ("&amp" before another character).
    """
    unescape = _closed if closed else html.unescape
    out: list[str] = []
    state = {"break": False, "skip": ""}

    def put(text: str) -> None:
        if state["skip"] or not text or (not text.strip() and (state["break"] or not out)):
            return
        if state["break"]:
            out.append("\n")
            state["break"] = False
        out.append(text)

    at, page = 0, page.replace("\r\n", "\n").replace("\r", "\n")
    while at < len(page):
        m = _HTML.search(page, at)
        put(unescape(page[at : m.start() if m else len(page)]))
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        closed = m["rest"].endswith("/")
        if m["end"]:
            if state["skip"]:
                if name == state["skip"] or (state["skip"] == "head" and name in ("body", "html")):
                    state["skip"] = ""
            elif name in HTML_BLOCKS and out:
                state["break"] = True
            continue
        if state["skip"] == "head" and name not in HTML_HEAD:
            state["skip"] = ""
        if not state["skip"]:
            if name in HTML_SKIPPED:
                state["skip"] = "" if closed else name
            elif name in HTML_BLOCKS and out:
                state["break"] = True
        if name in HTML_RAW or name in HTML_RCDATA:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            put(page[at:stop] if name in HTML_RAW else unescape(page[at:stop]))
            at = stop
    return "".join(out)


def _decoded(text: str) -> str:
    """Character references with a name or a valid number replaced, others left as they stand."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] == "#":
            n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else m[0]
        return html.entities.html5.get(name + ";", m[0])

    return _ENTITY.sub(one, text) if "&" in text else text


def _book_text(body: str, blocks: frozenset[str], skipped: frozenset[str], breaking: frozenset[str], empty: bool) -> str:
    """Text of a FictionBook body: block ends break the line, all breaks before a text are kept."""
    out: list[str] = []
    breaks, fresh, depth, at = 0, True, 0, 0

    def put(text: str) -> None:
        nonlocal breaks, fresh
        if fresh:
            text = text.lstrip(" \t\r\n")
        if not text:
            return
        if out:
            out.append("\n" * breaks)
        breaks, fresh = 0, False
        out.append(text)

    while at < len(body):
        m = _XML.search(body, at)
        if not depth:
            put(_decoded(body[at : m.start() if m else len(body)]))
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None and not depth:
            put(m["cdata"])
        if not m["name"]:
            continue
        name, closed = m["name"].rpartition(":")[2].lower(), m["rest"].endswith("/")
        if name in skipped:
            depth = max(0, depth + (-1 if m["end"] else 0 if closed else 1))
        elif depth:
            continue
        elif name in breaking or (m["end"] or closed) and name in blocks:
            breaks, fresh = breaks + 1, True
        elif empty and name == "empty-line" and not m["end"]:
            breaks, fresh = max(2, breaks + 1), True
    return "".join(out)


def fb2_to_text(body: str) -> str:
    return _book_text(body, FB2_BLOCKS, FB2_SKIPPED, frozenset(), True)


def fb3_to_text(body: str) -> str:
    return _book_text(body, FB3_BLOCKS, frozenset(), frozenset(("br",)), False)


# One alternative for each form of a tag; those that are not listed drop their value.
_PML = re.compile(
    r"""\\(?:(?P<slash>\\)|v(?P<note>.*?)(?:\\v|\Z)|a(?P<dec>.{3})|U(?P<hex>.{4})|(?P<cut>a.{0,2}\Z|U.{0,3}\Z)|(?P<head>x|X[0-9]?)|C(?P<mark>[0-9](?:="(?P<title>[^"]*)(?:"|\Z))?)?|"""
    r"""(?P<page>[pw])(?:="?(?:(?<=")[^"]*(?:"|\Z))?)?|F(?:n(?:="[^"]*(?:"|\Z))?)?|S(?:[pbd](?:="[^"]*(?:"|\Z))?)?|(?P<lone>\Z)|.(?:="[^"]*(?:"|\Z))?)|(?P<line>\r\n?|\n)|(?P<text>[^\\\r\n]+)""",
    re.S,
)


def pml_to_text(source: str) -> str:
    """Text of Palm markup; page and chapter marks make a blank line, runs of breaks at most one."""
    out: list[str] = []
    breaks = 0

    def put(text: str) -> None:
        nonlocal breaks
        for i, piece in enumerate(re.split(r"\r\n?|\n", text)):
            breaks = min(2, breaks + (i > 0))
            if piece:
                out.append(("\n" * breaks if out else "") + piece)
                breaks = 0

    for m in _PML.finditer(source):
        kind = m.lastgroup
        if m["text"]:
            put(m["text"])
        elif m["line"]:
            breaks = min(2, breaks + 1)
        elif m["slash"] or kind == "lone":
            put("\\")
        elif m["dec"] or m["hex"]:
            digits, base = (m["dec"], 10) if m["dec"] else (m["hex"], 16)
            good = re.fullmatch("[0-9]+" if base == 10 else "[0-9A-Fa-f]+", digits)
            n = int(digits, base) if good else -1
            put(chr(n) if good and not 0xD800 <= n < 0xE000 else m[0])
        elif m["cut"]:
            put(m[0])
        elif m["head"] or m["page"] or m["mark"]:
            breaks = 2
            if m["title"]:
                put(m["title"])
                breaks = 2
    return "".join(out)


def lrf_to_text(flow: str) -> str:
    """Text of an LRF flow: the places of pictures go."""
    return flow.replace("￼", "")
