"""One pass over the texts of books, with as many results as processors are given.

A processor is a named column over the text; a scan is one projection with a
column for each. Fallback processors run only for books that are unmet, as a
second branch that reads the remaining parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions.fingerprint import fingerprint
from codexa.functions.isbn import as13, find_isbns
from codexa.operators.resources import reading_text

#: Bytes of a text in which ISBNs are looked for first.
WINDOW_BYTES = 64 * 1024


@dataclass(frozen=True)
class Processor:
    """A result column; make(text) builds it."""

    name: str
    make: Callable[[Column], Column]

    def __post_init__(self) -> None:
        if not self.name or not callable(self.make):
            raise TypeError("a processor needs a name and a column to make")


def head(text: Column, n: int) -> Column:
    """The first n bytes of a text, without the invalid rest of a character that they cut; n <= 0 gives ''."""
    if n <= 0:
        return F.lit("")

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t if 4 * len(t) <= n else t[:n].encode("utf-8", "replace")[:n].decode("utf-8", "ignore"))

    return F.pandas_udf(cut, "string")(text)


def fingerprints(name: str = "fingerprint", **options) -> Processor:
    return Processor(name, lambda text: fingerprint(text, **options))


def text_head(n: int, name: str = "head") -> Processor:
    return Processor(name, lambda text: head(text, n))


def isbns(name: str = "isbns", window: int = WINDOW_BYTES, limit: int = 0) -> Processor:
    def make(text: Column) -> Column:
        found = find_isbns(head(text, window if window > 0 else WINDOW_BYTES))
        return F.slice(found, 1, limit) if limit > 0 else found

    return Processor(name, make)


def scan(texts: DataFrame, *processors: Processor | None) -> DataFrame:
    """texts(book_id, text) -> book_id and a column for each processor; None is skipped."""
    chosen = [p for p in processors if p is not None]
    if len({p.name for p in chosen}) != len(chosen):
        raise ValueError("two processors have the same name")
    return texts.select("book_id", *[p.make(F.col("text")).alias(p.name) for p in chosen])


def scan_reading_order(parts: DataFrame, *processors: Processor | None) -> DataFrame:
    """scan() over the linear parts(book_id, pos, linear, text) of each book, a newline between them."""
    return scan(reading_text(parts, "\n"), *processors)


def text_with_fingerprint(parts: DataFrame, **options) -> DataFrame:
    """(book_id, text, fingerprint): the linear text of each book and its fingerprint, worked out from one reading."""
    return scan_reading_order(parts, Processor("text", lambda text: text), fingerprints(**options))


def heads_only(parts: DataFrame, n: int) -> DataFrame:
    """The linear parts that the first n bytes of a book reach, for scans that need no more; other parts stay without text, so that no book is lost.

    A part after exactly n bytes is reached: the separator before it is the last of them. Parts of one place follow each
    other by text, as in the reading order.
    """
    text, linear = F.coalesce("text", F.lit("")), F.coalesce("linear", F.lit(False))
    before = Window.partitionBy("book_id").orderBy("pos", text).rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(linear, F.octet_length(text) + 1).otherwise(0)
    reached = parts.withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(~linear | (F.col("before") <= n)).drop("before")
    return reached.withColumn("text", F.when(linear, F.col("text")))


def book_isbns(parts: DataFrame, window: int = WINDOW_BYTES, limit: int = 0) -> DataFrame:
    """parts(book_id, pos, linear, in_order, text) -> (book_id, isbns).

    ISBNs of the head of the linear text; if these are fewer than `limit` (or there is no limit), of the
    heads of other parts of the reading order, then of resources outside it, each book once, first come.
    """
    window = window if window > 0 else WINDOW_BYTES
    linear = scan(reading_text(heads_only(parts, window), "\n"), isbns("found", window))
    first = linear.select("book_id", F.lit(0).alias("phase"), F.lit(0).cast("long").alias("pos"), "found")
    unmet = parts.where(~F.col("linear"))
    if limit > 0:
        unmet = unmet.join(linear.where(F.size("found") >= limit), "book_id", "left_anti")
    rest = unmet.select("book_id", F.when(F.col("in_order"), 1).otherwise(2).alias("phase"), F.col("pos").cast("long").alias("pos"), find_isbns(head(F.col("text"), window)).alias("found"))
    every = first.union(rest).where(F.size("found") > 0)
    merged = every.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("phase", "pos", "found"))).alias("hits"))
    books = parts.select("book_id").distinct()
    flat = books.join(merged, "book_id", "left").select("book_id", F.coalesce(F.flatten(F.transform("hits", lambda h: h["found"])), F.expr("cast(array() as array<string>)")).alias("isbns"))

    def once(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in lists:
            out = []
            for values in series:
                seen: dict[str, str] = {}
                for v in values:
                    seen.setdefault(as13(v), v)
                out.append(list(seen.values())[: limit if limit > 0 else None])
            yield pd.Series(out)

    once.__annotations__ = {"lists": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return flat.select("book_id", F.pandas_udf(once, "array<string>")("isbns").alias("isbns"))
