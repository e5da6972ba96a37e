"""Conversions between media types: a graph of functions, and the columns that run them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions import charset, markup
from codexa.functions.strings import FB2_BODY, FB3_BODY, HTML_TYPES, LRF_TEXT, PLAIN, PML, TEXTUAL

Step = Callable[[str], str]


class NoConversion(LookupError):
    """No path of conversions leads from one media type to the other."""


def normal(mime: str | None) -> str:
    return (mime or "").partition(";")[0].strip().lower()


def textual(mime: str | None) -> bool:
    m = normal(mime)
    return m.startswith("text/") or m.endswith(("+xml", "+json")) or m in TEXTUAL


class Registry:
    """A directed graph of conversions between media types."""

    def __init__(self, steps: dict[tuple[str, str], Step] | None = None) -> None:
        self.steps = dict(steps or {})

    def register(self, source: str, target: str, step: Step) -> Registry:
        """Add an edge, or replace it."""
        self.steps[normal(source), normal(target)] = step
        return self

    def alias(self, known: str, *others: str) -> Registry:
        """Give other source types the edges of a known one."""
        for (a, b), step in list(self.steps.items()):
            if a == normal(known):
                for other in others:
                    self.register(other, b, step)
        return self

    def find(self, source: str, target: str) -> Step | None:
        return self.steps.get((normal(source), normal(target)))

    def path(self, source: str, target: str) -> list[Step] | None:
        """Steps of the shortest path, of equal ones the first by name; empty for equal types, None if there is none."""
        source, target = normal(source), normal(target)
        seen: dict[str, list[Step]] = {source: []}
        queue = deque([source])
        while queue:
            at = queue.popleft()
            if at == target:
                return seen[at]
            for (a, b), step in sorted(self.steps.items(), key=lambda e: e[0]):
                if a == at and b not in seen:
                    seen[b] = [*seen[a], step]
                    queue.append(b)
        return None


def default_registry() -> Registry:
    out = Registry()
    for mime in HTML_TYPES:
        out.register(mime, PLAIN, markup.html_to_text)
    for mime, step in ((FB2_BODY, markup.fb2_to_text), (FB3_BODY, markup.fb3_to_text), (PML, markup.pml_to_text), (LRF_TEXT, markup.lrf_to_text)):
        out.register(mime, PLAIN, step)
    return out


DEFAULT = default_registry()


def converted(data: bytes | None, mime: str, target: str, hint: str | None = None, out: str | None = None, registry: Registry = DEFAULT) -> bytes:
    """A resource's bytes as another media type; equal types give the stored bytes unless a charset is asked for."""
    data = data or b""
    path = registry.path(mime, target)
    if path is None:
        raise NoConversion(f"{normal(mime)} to {normal(target)}")
    same = charset.normalize(out) in ("", charset.normalize(hint) or charset.UTF8)
    if not path and (same or not textual(mime)):
        return data
    if charset.normalize(hint) == charset.BINARY:
        text = data.decode("utf-8", "replace")
    else:
        text = charset.decode(data, hint, textual(mime))
    for step in path:
        text = step(text)
    return charset.encode(text, out)


def convert(data: Column, mime: Column, target: str = PLAIN, hint: Column | None = None, out: str | None = None, registry: Registry = DEFAULT) -> Column:
    """struct<data binary, error string>: each row's bytes as `target`; error is NO_TRANSFORMER or UNKNOWN_CHARSET, else null."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for datas, mimes, hints in batches:
            rows = []
            for d, m, h in zip(datas, mimes, hints, strict=True):
                try:
                    rows.append((converted(None if d is None else bytes(d), m or "", target, h, out, registry), None))
                except NoConversion:
                    rows.append((None, "NO_TRANSFORMER"))
                except LookupError:
                    rows.append((None, "UNKNOWN_CHARSET"))
            yield pd.DataFrame(rows, columns=["data", "error"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "data binary, error string")(data, mime, F.lit(None).cast("string") if hint is None else hint)


def to_text(text: Column, step: Step) -> Column:
    """A converter over a string column; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else step(t))

    return F.pandas_udf(run, "string")(text)
