"""Line deduplication by overlapping three-line windows.

A window is three consecutive lines that have a word; lines without one are
skipped and never removed. Windows that occur more than once anywhere are found
by their 128-bit hash; every line that a later occurrence covers goes. The first
occurrence is the one of smallest (doc_id, text hash, position). Only hashes and
positions are shuffled to find them; the count is a partial aggregate, so a
window that stands in a third of all documents is no hot key, and the joins back
are between settled tables, which adaptive execution may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import as_bytes, bounded, part, pieces, settle, text_key

WINDOW = 3
BLANK = b" \t\n\x0b\x0c\r"


def lines_of(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, split at \\n, and the numbers of those that have a word."""
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip(BLANK)]


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in pieces(batches, "text"):
        rows, found, at = [], [], []
        for n, text in enumerate(as_bytes(batch.column("text"))):
            lines, full = lines_of(text)
            hashes = [digest(lines[i]) for i in full]
            count = len(full) - window + 1
            if count > 0:
                rows += [n] * count
                found += [digest(b"".join(hashes[i : i + window])) for i in range(count)]
                at += range(count)
        keys = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(at, pa.int32())],
            ["h1", "h2", "doc_id", "text_key", "at"],
        )


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, text_key, starts): where later occurrences of repeated windows start.

    starts counts lines that have a word. Documents without any have no row. Rows equal in doc_id and
    text are one document. Null and empty texts have no window.
    """
    keyed = bounded(docs).select("doc_id", "text", text_key().alias("text_key"))
    kind = dict(keyed.dtypes)["doc_id"]
    schema = f"h1 long, h2 long, doc_id {kind}, text_key long, at int"
    windows = keyed.mapInArrow(part(_windows, window=window), schema)
    counts = settle(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    repeated = settle(windows.join(counts, ["h1", "h2"], "left_semi"))
    first = settle(repeated.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key", "at")).alias("first")))
    later = repeated.join(first, ["h1", "h2"]).where(~F.struct("doc_id", "text_key", "at").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("starts"))


def merged(starts: list[int], window: int) -> list[int]:
    """The positions that windows at these starts cover, in order."""
    out, end = [], 0
    for s in sorted(starts):
        out += range(max(s, end), s + window)
        end = s + window
    return out


def _rebuild(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        kept, all_, gone = [], [], []
        for text, starts in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
            lines, full = lines_of(text)
            drop = {full[i] for i in merged(starts, window)} if starts else ()
            kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text)
            all_.append(len(full))
            gone.append(len(drop))
        if digest:
            last = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        else:
            null = pc.is_null(batch.column("text")).to_pylist()
            last = pa.array([None if n else x for x, n in zip(kept, null, strict=True)], pa.binary()).cast(pa.string())
        others = [batch.column(n) for n in batch.schema.names if n not in ("text", "starts")]
        names = [n for n in batch.schema.names if n not in ("text", "starts")]
        yield pa.RecordBatch.from_arrays(
            [*others, pa.array(all_, pa.int64()), pa.array(gone, pa.int64()), last], [*names, "n_lines", "n_removed", "kept_sha256" if digest else "kept"]
        )


def drop_repeated(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """documents -> (doc, n_lines, n_removed, kept), a row for each input row.

    doc: the input row as a struct, without text where `digest` is set. n_lines: lines that have a word.
    kept: what is left, joined by \\n (null for a null text); with `digest`, kept_sha256 instead.
    """
    found = covered(docs, window).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "starts")
    names = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*names).alias("doc"), "text", F.col("doc_id").alias("id"), text_key().alias("key"))
    rows = packed.join(found, packed["id"].eqNullSafe(found["id_"]) & (packed["key"] == found["key_"]), "left").select("doc", "text", "starts")
    kind = dict(rows.dtypes)["doc"]
    return rows.mapInArrow(
        part(_rebuild, window=window, digest=digest), f"doc {kind}, n_lines long, n_removed long, {'kept_sha256' if digest else 'kept'} string"
    )


def without_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated lines taken out, columns as they were; n_chars follows the text.

    A document of which nothing but blank lines is left goes; one that had no word before stays.
    """
    rows = drop_repeated(docs, window).where("n_removed = 0 OR n_removed < n_lines")
    value = {"text": F.col("kept"), "n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[value.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines that each document loses, and a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated(docs, digest=True).select("doc.doc_id", "n_lines", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, x FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), worded AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p
  FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT a.doc_id, a.p, a.x AS x1, b.x AS x2, c.x AS x3
  FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN worded c ON a.doc_id = c.doc_id AND c.p = a.p + 2
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, p + o AS p FROM later, (VALUES (0), (1), (2)) t(o)
), dropped AS (
  SELECT w.doc_id, w.i FROM worded w JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p
), kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS t
  FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.i = d.i WHERE d.i IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id,
  coalesce((SELECT count(*) FROM worded w WHERE w.doc_id = d.doc_id), 0) AS n_lines,
  coalesce((SELECT count(*) FROM dropped g WHERE g.doc_id = d.doc_id), 0) AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
