"""What a help page says about its book: meta elements, then marked spans, then labelled table cells."""

from __future__ import annotations

from html.parser import HTMLParser

from codexa.functions.isbn import declared_isbn, validated

# Keys of meta elements, the first that has a value counts.
PUBLISHER = ("publisher", "dc.publisher", "dc:publisher", "dcterms.publisher", "dcterms:publisher", "imprint")
DATE = ("date", "dc.date", "dc:date", "dcterms.date", "dcterms:date", "dcterms.issued", "dcterms:issued")
IDENTIFIER = ("dc.identifier", "dc:identifier", "dcterms.identifier", "dcterms:identifier", "identifier")
# Labels in front of a publisher.
LABELS = ("publisher", "imprint", "kiadó", "kiado")
_EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Element:
    def __init__(self, name: str, attributes: dict[str, str], above: _Element | None) -> None:
        self.name, self.attributes, self.above = name, attributes, above
        self.inside: list[_Element | str] = []

    def text(self) -> str:
        """All text inside, by a worklist, so that depth does not matter."""
        out, work = [], [self]
        while work:
            x = work.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                work += reversed(x.inside)
        return "".join(out)


class Page(HTMLParser):
    """The elements of a page in document order."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self._open = _Element("", {}, None)
        self.elements: list[_Element] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("td", "th", "tr"):  # a cell or row ends the one before
            self._leave({"td", "th"} if tag != "tr" else {"td", "th", "tr"})
        element = _Element(tag, {k.lower(): v or "" for k, v in reversed(attrs)}, self._open)
        self._open.inside.append(element)
        self.elements.append(element)
        if tag not in _EMPTY:
            self._open = element

    def _leave(self, names: set[str]) -> None:
        at, last = self._open, None
        while at is not None and at.name != "table":
            if at.name in names:
                last = at
            at = at.above
        if last is not None:
            self._open = last.above

    def handle_endtag(self, tag: str) -> None:
        at = self._open
        while at is not None and at.name != tag:
            at = at.above
        if at is not None and at.above is not None:
            self._open = at.above

    def handle_data(self, data: str) -> None:
        self._open.inside.append(data)

    def metas(self, *keys: str) -> list[str]:
        """Values of the keys that are not blank, key by key."""
        found = [((e.attributes.get("name") or e.attributes.get("property") or "").strip().lower(), e.attributes.get("content", "").strip()) for e in self.elements if e.name == "meta"]
        return [value for key in keys for k, value in found if k == key and value]

    def marked(self, word: str) -> str:
        """Text of the first span whose class holds the word and that has text."""
        spans = (e.text().strip() for e in self.elements if e.name == "span" and word in e.attributes.get("class", "").lower())
        return next((t for t in spans if t), "")

    def labelled(self, label: str) -> str:
        """The value beside the first cell of plain text that holds the label: the next cell, else the row without the label."""
        for e in self.elements:
            if e.name != "td" or any(isinstance(x, _Element) for x in e.inside) or label not in e.text().lower():
                continue
            row = e.above
            later = [x for x in row.inside[row.inside.index(e) + 1 :] if isinstance(x, _Element)]
            if later and later[0].name == "td":
                value = later[0].text()
            else:
                value = row.text().strip()
                value = value[len(label) :] if value.lower().startswith(label) else value
            if value := value.strip().removeprefix(":").strip():
                return value
        return ""


def without_label(value: str) -> str:
    head, colon, rest = value.strip().partition(":")
    return rest.strip() if colon and head.strip().lower() in LABELS else value.strip()


def publisher(page: Page) -> str:
    return without_label(next(iter(page.metas(*PUBLISHER)), "") or page.marked("imprint") or page.labelled("publisher"))


def date(page: Page) -> str:
    return next(iter(page.metas(*DATE)), "")


def isbn(page: Page) -> str:
    """The first value with a right check digit: places for ISBNs are read for their digits, general identifiers as they stand."""
    digits = lambda value: validated("".join(c for c in value if c in "0123456789xX").upper())
    for value in page.metas("isbn"):
        if found := digits(value):
            return found
    for value in page.metas(*IDENTIFIER):
        if found := declared_isbn(value):
            return found
    return digits(page.marked("isbn")) or digits(page.labelled("isbn")) or ""
