"""Files to tables: books, resources, reading orders.

One mapInArrow over the binary rows parses each file once; the three tables are
projections of its result. A file that fails becomes a row with an error_code
and fails nothing else. What `with_content=False` leaves out is never copied.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codexa.functions.conversion import NoConversion, convert, converted
from codexa.functions.strings import PLAIN
from codexa.operators.resources import reading_text
from codexa.sources.detect import READERS
from codexa.sources.model import BOOK, ORDER, RESOURCE, Book, BookError, Corrupt, Options, Protected, Unsupported, canonical

PARSED = f"{BOOK}, resources array<struct<{', '.join(f.replace(' ', ':', 1) for f in RESOURCE.split(', '))}>>, reading_order array<struct<{', '.join(f.replace(' ', ':', 1) for f in ORDER.split(', '))}>>"


def parse(data: bytes, options: Options = Options()) -> Book:
    """One file's book; BookError if it has none."""
    options = options.resolved()
    for _, supports, read in READERS:
        if supports(data):
            if read is None:
                raise Unsupported("no reader for this format")
            try:
                book = read(data, options)
            except BookError:
                raise
            except RecursionError as e:
                raise Corrupt("nested too deep") from e
            except (struct.error, IndexError, KeyError, ValueError, UnicodeError, OverflowError, MemoryError) as e:
                raise Corrupt(f"{type(e).__name__}: {e}") from e
            canonical(book)
            return book
    raise Unsupported("no reader for this file")


def row(path: str, data: bytes | None, options: Options) -> dict:
    """A parsed file as a row of PARSED."""
    data = data or b""
    try:
        book, error = parse(data, options), (None, None)
    except BookError as e:
        book, error = Book(), (e.code, str(e))
    place = {id(r): i for i, r in enumerate(book.resources)}
    return {
        "path": path, "file_type": book.file_type, "version": book.version, "sha256": hashlib.sha256(data).hexdigest(), "title": book.title, "authors": book.authors, "description": book.description,
        "subjects": book.subjects, "languages": book.languages, "identifiers": [{"scheme": s, "value": v} for s, v in book.identifiers], "publisher": book.publisher,
        "publication_date": book.publication_date, "series": book.series, "series_index": book.series_index, "cover_pos": place[id(book.cover)] if book.cover else None,
        "error_code": error[0], "error_msg": error[1],
        "resources": [{"pos": i, **{k: getattr(r, k) for k in ("id", "name", "media_type", "href", "resolved_href", "properties", "charset", "size", "content", "error_code", "error_msg")}} for i, r in enumerate(book.resources)],
        "reading_order": [{"pos": i, "resource_pos": place[id(r)], "linear": linear} for i, (r, linear) in enumerate(book.order)],
    }


def parse_books(files: DataFrame, content: str = "content", path: str = "path", **options) -> DataFrame:
    """Rows with a binary column -> PARSED, a row for each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(PARSED)
    arrow = to_arrow_schema(schema)
    chosen = Options(**options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path"), batch.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist([row(p.as_py(), data.as_py(), chosen)], schema=arrow)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)


def read_books(spark: SparkSession, path: str, **options) -> DataFrame:
    """All files below a path -> PARSED. A blank path is an error."""
    if not path.strip():
        raise Unsupported("no path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path.strip())
    return parse_books(files.select("path", "content"), **options)


def books(parsed: DataFrame) -> DataFrame:
    return parsed.drop("resources", "reading_order")


def resources(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("book_id"), F.explode("resources").alias("r")).select("book_id", "r.*")


def reading_order(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("book_id"), F.explode("reading_order").alias("o")).select("book_id", "o.*")


def parts(parsed: DataFrame) -> DataFrame:
    """(book_id, pos, linear, in_order, text, error): each part of the reading order, then other resources, as plain text."""
    rows = parsed.select("path", "resources", F.col("reading_order").alias("o"))
    order = rows.select(F.col("path").alias("book_id"), "resources", F.explode("o").alias("o")).select(
        "book_id", F.col("o.pos").cast("long").alias("pos"), F.col("o.linear").alias("linear"), F.lit(True).alias("in_order"), F.get("resources", F.col("o.resource_pos")).alias("r")
    )
    used = F.transform("o", lambda x: x["resource_pos"])
    rest = rows.select(F.col("path").alias("book_id"), F.explode(F.filter("resources", lambda r: ~F.array_contains(used, r["pos"]))).alias("r")).select(
        "book_id", (F.col("r.pos") + 1_000_000).cast("long").alias("pos"), F.lit(False).alias("linear"), F.lit(False).alias("in_order"), "r"
    )
    both = order.unionByName(rest).withColumn("c", convert(F.col("r.content"), F.col("r.media_type"), PLAIN, F.col("r.charset"), "utf-8"))
    return both.select("book_id", "pos", "linear", "in_order", F.make_valid_utf8(F.col("c.data").cast("string")).alias("text"), F.coalesce("r.error_code", "c.error").alias("error"))


def book_texts(parsed: DataFrame) -> DataFrame:
    """(book_id, text, error_code): linear parts joined by newlines; a linear part that cannot be converted fails its book alone."""
    rows = parts(parsed).where("in_order")
    bad = rows.where("linear AND error IS NOT NULL").groupBy("book_id").agg(F.min("error").alias("error_code"))
    return reading_text(rows, "\n").join(bad, "book_id", "left").select("book_id", F.when(F.col("error_code").isNull(), F.col("text")).alias("text"), "error_code")


def reading_order_as(parsed: DataFrame, media_type: str | None = None, charset: str | None = None) -> DataFrame:
    """(book_id, data, error_code): the bytes of the linear parts, one after another, as a media type, in a charset, both or as stored.

    A part that cannot be converted fails its book alone.
    """
    order = parsed.select(F.col("path").alias("book_id"), "resources", F.explode("reading_order").alias("o")).where("o.linear")
    rows = order.select("book_id", F.col("o.pos").alias("pos"), F.get("resources", F.col("o.resource_pos")).alias("r"))
    if media_type is None and charset is None:
        done = rows.select("book_id", "pos", F.coalesce("r.content", F.lit(b"")).alias("data"), F.col("r.error_code").alias("error"))
    else:

        def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for datas, mimes, hints in batches:
                found = []
                for data, mime, hint in zip(datas, mimes, hints, strict=True):
                    try:
                        found.append((converted(None if data is None else bytes(data), mime or "", media_type or mime or "", hint, charset), None))
                    except NoConversion:
                        found.append((None, "NO_TRANSFORMER"))
                    except LookupError:
                        found.append((None, "UNKNOWN_CHARSET"))
                yield pd.DataFrame(found, columns=["data", "error"])

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
        c = F.pandas_udf(run, "data binary, error string")("r.content", "r.media_type", "r.charset")
        done = rows.withColumn("c", c).select("book_id", "pos", F.coalesce("c.data", F.lit(b"")).alias("data"), F.coalesce("r.error_code", "c.error").alias("error"))
    whole = done.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("parts"), F.min("error").alias("error_code"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    return whole.select("book_id", F.when(F.col("error_code").isNull(), joined).alias("data"), "error_code")


def protected(parsed: DataFrame) -> Column:
    return parsed["error_code"] == Protected.code
