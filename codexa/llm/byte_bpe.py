"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens on the JVM. A task numbers the distinct words of a
block of documents by (bucket of the word's hash, word) and keeps, for each
document, its words' numbers in order of position. Only distinct words travel:
one packed, compressed list for each block and bucket. All lists of a bucket
meet in one task, which encodes each distinct word once and sends the ids back
to the blocks, where documents are put together by position. Decoding looks up
each id in the table of token bytes.

A word goes out once for each block however often it occurs, so frequent words
are no hot key. A block is bounded by its text. The number of buckets grows with
the bytes of the input, as long as a block has words enough to fill them; a
bucket is read as a stream, so that its size costs time only, no memory.

Texts are cut twice, for the words and for the documents: writing the cut blocks
down would take more disk than the texts. The two passes must see the same rows
in the same order, which files give and a shuffle may not; so `encode` writes its
input down first unless the caller says that it comes from files.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import BATCH_BYTES, bounded, part, release, settle

#: Text of one block, in bytes.
BLOCK_BYTES = 16_000_000
#: Text for which there is one bucket, in bytes, and the bytes of a block for each bucket that it may fill.
BUCKET_BYTES, PER_BUCKET = 8_000_000, 256
#: Encoded words that a task remembers; beyond that it starts afresh (and may encode a word again).
REMEMBERED = 1_000_000
#: Ranges whose numbers are written out at once.
RANGES = 1 << 15


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: a token's bytes in base64 and its rank, one a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pre_tokens(text, pattern: str):
    """Column: the pattern's matches in order; null counts as empty. \\s, \\d and \\w cover Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def _pack(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Block:
    """Documents of a task until they fill a block; then its words, or its documents' word numbers."""

    def __init__(self) -> None:
        self.words: list[tuple[pa.Array, np.ndarray]] = []
        self.docs: list[tuple[pa.Array, np.ndarray]] = []
        self.size = 0

    def add(self, ids: pa.Array, words: pa.ListArray) -> None:
        # distinct words and numbers, and a copy of the ids: a slice of a batch would keep all of its text
        flat = words.flatten().cast(pa.large_binary())
        coded = flat.dictionary_encode()
        self.words.append((coded.dictionary, coded.indices.to_numpy()))
        self.docs.append((ids.take(pa.array(np.arange(len(ids)))), pc.list_value_length(words).to_numpy(zero_copy_only=False)))
        self.size += pc.sum(pc.binary_length(flat)).as_py() or 0

    def numbered(self, buckets: int) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
        """The block's key, its words in the order of their numbers, their buckets, each word's number."""
        coded, pieces = pa.chunked_array([w for w, _ in self.words]).dictionary_encode().combine_chunks(), [(len(w), at) for w, at in self.words]
        self.words = []
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0) if coded.num_chunks else pa.array([], pa.binary()).dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        bucket = (hashes % np.uint64(buckets)).astype(np.int32)
        order = pc.sort_indices(pa.table({"b": pa.array(bucket), "w": coded.dictionary}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        numbers = number[coded.indices.to_numpy()] if len(order) else number
        ends = np.cumsum([n for n, _ in pieces])
        numbers = np.concatenate([numbers[end - n : end][at] for end, (n, at) in zip(ends, pieces, strict=True)])
        # the key follows from the block's content, so that a task that runs again gives the same
        key = xxhash.xxh64(hashes[order].tobytes())
        key.update(numbers.astype("<u4").tobytes())
        return np.uint64(key.intdigest()).astype(np.int64).item(), coded.dictionary.take(pa.array(order)), bucket[order], numbers


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, side: str, limit: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, words) -> rows of the words or of the documents of each block."""
    block = _Block()

    def out() -> Iterator[pa.RecordBatch]:
        key, words, bucket, numbers = block.numbered(buckets)
        if side == "words":
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype("<u4")
            shrink, rows = zstandard.ZstdCompressor(level=1), []
            for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                some = slice(edges[b], edges[b + 1])
                rows.append((b, shrink.compress(np.uint32(edges[b + 1] - edges[b]).tobytes() + sizes[some].tobytes() + b"".join(words[some].to_pylist()))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([key] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                ["bucket", "block", "blob"],
            )
        else:
            at = 0
            for ids, counts in block.docs:
                n = int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([counts.tolist()], pa.list_(pa.int32())),
                        pa.array([_pack(numbers[at : at + n])], pa.binary()),
                    ],
                    ["block", "doc_id", "counts", "blob"],
                )
                at += n

    for batch in batches:
        words = batch.column("words")
        sizes = np.add.reduceat(
            np.append(pc.binary_length(words.flatten()).to_numpy(zero_copy_only=False), 0).astype(np.int64),
            np.minimum(words.offsets.to_numpy()[:-1] - words.offsets[0].as_py(), len(words.flatten())),
        ) if len(words) else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)], strict=True):
            block.add(batch.column("doc_id").slice(a, b - a), words.slice(a, b - a))
            if block.size >= limit:
                yield from out()
                block = _Block()
                release()
    if block.docs:
        yield from out()


@functools.lru_cache(maxsize=2)
def _encoder(path_or_key, pattern, ranks=None):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.table if ranks else read_ranks(path_or_key), special_tokens={})


class _Ranks:
    """A vocabulary that can be a key of a cache: equal if its file is."""

    def __init__(self, path: str, table: dict[bytes, int]) -> None:
        self.path, self.table = path, table

    def __hash__(self) -> int:
        return hash(self.path)

    def __eq__(self, other) -> bool:
        return isinstance(other, _Ranks) and self.path == other.path


def _encode(batches: Iterator[pa.RecordBatch], ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, block, blob of words) -> (block, bucket, blob of ids)."""
    encode = _encoder(ranks.value.path, pattern, ranks.value).encode_ordinary
    known: dict[bytes, list[int]] = {}
    bucket, expand, shrink = None, zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs = []
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if b != bucket or len(known) > REMEMBERED:
                known, bucket = {}, b
            raw = expand.decompress(blob)
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
            start, counts, ids = 4 + 4 * n, [], []
            for end in ends:
                word = raw[start:end]
                start = end
                got = known.get(word)
                if got is None:
                    got = known[word] = encode(word.decode())
                counts.append(len(got))
                ids += got
            blobs.append(shrink.compress(np.uint32(n).tobytes() + np.array(counts, "<u4").tobytes() + np.array(ids, "<u4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), batch.column("bucket"), pa.array(blobs, pa.binary())], ["block", "bucket", "blob"]
        )


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start..start+count, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What stands in all ranges start..start+count, one after another."""
    parts = [values[_ranges(starts[i : i + RANGES], counts[i : i + RANGES])] for i in range(0, len(starts), RANGES)]
    return np.concatenate(parts) if parts else values[:0]


class Tokens:
    """The table of token bytes; decode() joins ids to it."""

    def __init__(self, table: dict[bytes, int]) -> None:
        by_id = sorted(table.items(), key=lambda x: x[1])
        self.ids = np.array([i for _, i in by_id], np.int64)
        self.sizes = np.array([len(t) for t, _ in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the size of each."""
        at = np.searchsorted(self.ids, ids)
        if len(ids) and (at.max() >= len(self.ids) or (self.ids[at] != ids).any()):
            raise ValueError("an id is not in the vocabulary")
        return _gathered(self.data, self.starts[at], self.sizes[at]), self.sizes[at]


@functools.lru_cache(maxsize=2)
def _tokens(ranks: _Ranks) -> Tokens:
    return Tokens(ranks.table)


def emit_ids(keys: pa.Array, ids: np.ndarray, ends: np.ndarray, tokens: Tokens) -> pa.RecordBatch:
    """(doc_id, ids)."""
    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])


def emit_digests(keys: pa.Array, ids: np.ndarray, ends: np.ndarray, tokens: Tokens) -> pa.RecordBatch:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    data, sizes = tokens.decode(ids)
    raw, text = ids.astype("<u4").tobytes(), data.tobytes()
    at = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))].tolist()
    spans = [0, *ends.tolist()]
    pairs = range(len(ends))
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array(np.diff(spans), pa.int64()),
            pa.array([hashlib.sha256(raw[4 * spans[i] : 4 * spans[i + 1]]).hexdigest() for i in pairs], pa.string()),
            pa.array([hashlib.sha256(text[at[i] : at[i + 1]]).hexdigest() for i in pairs], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _assemble(batches: Iterator[pa.RecordBatch], ranks, emit: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, tag, bucket): a block's ids (tag 0), then its documents (tag 1)."""
    tokens, expand = _tokens(ranks.value), zstandard.ZstdDecompressor()
    block, last, parts = None, None, []
    counts = ids = starts = None
    for batch in batches:
        for i in range(batch.num_rows):
            key, tag, bucket, blob = (batch.column(c)[i].as_py() for c in ("block", "tag", "bucket", "blob"))
            if key != block:
                block, last, parts, counts = key, None, [], None
            if tag == 0:
                if bucket == last:  # two blocks of equal content: the same words came twice
                    continue
                last = bucket
                raw = expand.decompress(blob)
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                parts.append((np.frombuffer(raw, "<u4", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", -1, 4 + 4 * n)))
                continue
            if counts is None:
                none = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
                counts, ids = (np.concatenate(x) for x in zip(*(parts or none), strict=True))
                starts, parts = np.cumsum(counts) - counts, []
            numbers = _unpack(blob).astype(np.int64)
            if len(numbers) and numbers.max() >= len(counts):
                raise RuntimeError("a block lacks its words: its documents were read in another order the second time")
            own = counts[numbers]
            stream = _gathered(ids, starts[numbers], own)
            words = np.array(batch.column("counts")[i].as_py(), np.int64)
            ends = np.concatenate(([0], np.cumsum(own)))[np.cumsum(words)]
            yield emit(batch.column("doc_id")[i].values, stream, ends, tokens)


def encode(docs: DataFrame, path: str, pattern: str, emit: Callable = emit_ids, schema: str = "ids array<int>", limit: int = BLOCK_BYTES, buckets: int | None = None, from_files: bool = False) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, ids) by the ranks in the .tiktoken file at `path`.

    One row for each input row, repeated rows and null ids included; a null or empty text has no
    ids; no rows give no rows. `emit` and `schema` choose what a row holds: emit_ids, or emit_digests,
    which also decodes. from_files: docs is a plain read of files, whose rows come in the same order again.
    """
    spark = bounded(docs).sparkSession
    docs = docs.select("doc_id", "text") if from_files else settle(docs.select("doc_id", "text"))
    ranks = spark.sparkContext.broadcast(_Ranks(path, read_ranks(path)))  # a vocabulary: of fixed size
    kind = dict(docs.dtypes)["doc_id"]
    cut = docs.select("doc_id", pre_tokens(F.col("text"), pattern).alias("words"))
    if not buckets:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(64, min(limit // PER_BUCKET, size // BUCKET_BYTES))
    side = part(_blocks, buckets=buckets, limit=limit)
    words = cut.mapInArrow(part(side, side="words"), "bucket int, block long, blob binary")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        part(_encode, ranks=ranks, pattern=pattern), "block long, bucket int, blob binary"
    )
    rows = cut.mapInArrow(part(side, side="docs"), f"block long, doc_id array<{kind}>, counts array<int>, blob binary")
    both = coded.select(
        "block", F.lit(0).alias("tag"), "bucket", "blob", F.lit(None).cast(f"array<{kind}>").alias("doc_id"), F.lit(None).cast("array<int>").alias("counts")
    ).unionByName(rows.select("block", F.lit(1).alias("tag"), F.lit(-1).alias("bucket"), "blob", "doc_id", "counts"))
    return both.repartition("block").sortWithinPartitions("block", "tag", "bucket").mapInArrow(part(_assemble, ranks=ranks, emit=emit), f"doc_id {kind}, {schema}")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _decode(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(ranks.value)
    for batch in batches:
        out = [None if x is None else tokens.decode(np.array(x, np.int64))[0].tobytes() for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes); null ids give null, an id outside the vocabulary is an error."""
    ranks = rows.sparkSession.sparkContext.broadcast(_Ranks(path, read_ranks(path)))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "ids").mapInArrow(part(_decode, ranks=ranks), f"doc_id {kind}, bytes binary")


def encoded_digests(docs: DataFrame, from_files: bool = True) -> DataFrame:
    """The contract's columns for documents(doc_id, text) read from files; else from_files must be False."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, emit_digests, DIGESTS, from_files=from_files)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
