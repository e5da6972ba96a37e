"""SimHash near-duplicates: fingerprints, then a binary trie joined with itself.

Two 64-bit fingerprints that differ in at most 3 bits agree on one of four
16-bit blocks. Every distinct fingerprint is dealt out once per block, keyed by
the block and its value; within a key the remaining 48 bits form a binary trie,
and pairs of nodes are walked down together, the differing bits added up and a
pair dropped when it is over budget. A key with too many fingerprints is split
the same way on its remaining bits (four blocks of 12, of 9, ...), which is as
exact: the remaining bits also differ in at most 3 places. Links found inside a
key are reduced to a spanning forest before they leave the task, so a dense
group costs rows in proportion to its size, not to its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import as_bytes, part, pieces, settle, text_key
from codexa.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
BUDGET = 3
#: Distinct fingerprints of one key that a task walks at once; larger keys are split on further bits.
KEY_ROWS = 50_000
#: Node pairs held at once in a walk; further ones wait on a stack.
FRONTIER = 400_000


def shingle_hashes(text: bytes, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of space-joined words, A-Z lowered; fewer words: of the whole sequence."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(tokens) - words + 1)
    stops = ends[len(ends) - last :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), stops.tolist(), strict=True)), np.uint64, last)


def bit_counts(hashes: np.ndarray, step: int = 65_536) -> np.ndarray:
    """How many hashes have each bit, most significant first."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), step):
        total += np.unpackbits(hashes[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if over half of the shingles' hashes have it; 0 for a text without words."""
    hashes = shingle_hashes(text, words, seed)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        marks = np.array([fingerprint(t, words, seed) for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(marks)], ["doc_id", "text_key", "mark"])


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, mark): the fingerprint's 64 bits in a long, for each row of documents(doc_id, text)."""
    rows = docs.select("doc_id", "text", text_key().alias("text_key"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(part(_fingerprints, words=words, seed=seed), f"doc_id {kind}, text_key long, mark long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """roots after joining each a[i] with b[i]; every entry is again the smallest of its set."""
    while True:
        left, right = roots[a], roots[b]
        open_ = left != right
        if not open_.any():
            return roots
        a, b, left, right = a[open_], b[open_], left[open_], right[open_]
        low = np.minimum(left, right)
        np.minimum.at(roots, left, low)
        np.minimum.at(roots, right, low)
        while True:
            up = roots[roots]
            if np.array_equal(up, roots):
                break
            roots = up


def _spread(alo, ahi, blo, bhi):
    """All (i, j) of the ranges, each unordered pair of a range with itself once."""
    wide = bhi - blo
    count = (ahi - alo) * wide
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    i, j = alo[owner] + at // wide[owner], blo[owner] + at % wide[owner]
    keep = i < j
    return i[keep], j[keep]


def trie_forest(keys: np.ndarray, rest: np.ndarray, marks: np.ndarray, width: int, budget: int = BUDGET, frontier: int = FRONTIER) -> np.ndarray:
    """For rows sorted by (keys, rest): the first row of each row's set, sets being linked rows of equal key.

    A node is a range of rows that share a key and a prefix of `rest` (its `width` low bits).
    """
    n = len(marks)
    roots = np.arange(n)
    if n < 2:
        return roots
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    ones: dict[int, np.ndarray] = {}

    def halves(lo, hi, depth):
        if depth not in ones:
            bit = (rest >> np.uint64(width - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int32), dtype=np.int32)))
        return hi - (ones[depth][hi] - ones[depth][lo])

    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, spent = stack.pop()
        if len(alo) > frontier:
            half = len(alo) // 2
            stack.append((depth, *(x[half:] for x in (alo, ahi, blo, bhi, spent))))
            stack.append((depth, *(x[:half] for x in (alo, ahi, blo, bhi, spent))))
            continue
        if len(alo) > frontier // 8:  # pairs whose rows are all in one set already can bring nothing new
            change = np.concatenate(([0], np.cumsum(roots[1:] != roots[:-1])))
            done = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (roots[alo] == roots[blo])
            alo, ahi, blo, bhi, spent = (x[~done] for x in (alo, ahi, blo, bhi, spent))
        leaf = ((ahi - alo) * (bhi - blo) <= 16) | (depth == width)
        if leaf.any():
            # a range at full depth holds equal rests: keys that share a hash, verified below like any pair
            i, j = _spread(alo[leaf], ahi[leaf], blo[leaf], bhi[leaf])
            near = _apart(marks[i], marks[j]) <= budget
            roots = _merge(roots, i[near], j[near])
            alo, ahi, blo, bhi, spent = (x[~leaf] for x in (alo, ahi, blo, bhi, spent))
        if not len(alo):
            continue
        am, bm = halves(alo, ahi, depth), halves(blo, bhi, depth)
        own = alo == blo
        off = ~own
        out = [
            (alo, am, blo, bm, spent),
            (am, ahi, bm, bhi, spent),
            (alo, am, bm, bhi, spent + 1),
            tuple(x[off] for x in (am, ahi, blo, bm, spent + 1)),
        ]
        alo, ahi, blo, bhi, spent = (np.concatenate(x) for x in zip(*out, strict=True))
        live = (ahi > alo) & (bhi > blo) & (spent <= budget) & ~((alo == blo) & (ahi - alo < 2))
        stack.append((depth + 1, *(x[live] for x in (alo, ahi, blo, bhi, spent))))
    return roots


def _forest(batches: Iterator[pa.RecordBatch], width: int, budget: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, rest, mark) -> links (a, b) that connect what is linked within a key."""
    held: list[np.ndarray] = []

    def links(block: np.ndarray) -> pa.RecordBatch:
        keys, rest, marks = block
        roots = trie_forest(keys, rest.view(np.uint64), marks.view(np.uint64), width, budget)
        at = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.RecordBatch.from_arrays([pa.array(marks[roots[at]]), pa.array(marks[at])], ["a", "b"])

    for batch in batches:
        block = np.stack([batch.column(c).to_numpy() for c in ("key", "rest", "mark")])
        held.append(block)
        if sum(b.shape[1] for b in held) >= rows:
            block = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(block[0], block[0, -1]))  # the last key may go on
            if cut:
                yield links(block[:, :cut])
            held = [block[:, cut:]]
    if held:
        yield links(np.concatenate(held, axis=1))


def _deal(rows: DataFrame, width: int, blocks: int) -> DataFrame:
    """Each row once per block of its `width` remaining bits; the block's value goes into the key."""
    edges = [i * width // blocks for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    cut = [
        F.struct(
            F.xxhash64("key", F.lit(at), F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << n) - 1))).alias("key"),
            (
                F.shiftleft(F.shiftrightunsigned("rest", at + n), at) if at + n < 64 else F.lit(0).cast("long")
            ).bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << at) - 1).cast("long"))).alias("rest"),
        )
        for at, n in spans
    ]
    return rows.select("mark", F.explode(F.array(*cut)).alias("x")).select("x.key", "x.rest", "mark"), width - min(n for _, n in spans)


def fingerprint_links(marks: DataFrame, budget: int = BUDGET, key_rows: int = KEY_ROWS) -> DataFrame:
    """marks(mark), distinct -> links (a, b) that connect all marks at `budget` differing bits or fewer.

    Not all pairs: a spanning forest for each key, which leaves the components as they are.
    """
    rows, width, found = marks.select(F.lit(0).cast("long").alias("key"), F.col("mark").alias("rest"), "mark"), BITS, None
    while True:
        dealt, width = _deal(rows, width, budget + 1)
        large = settle(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > key_rows).select("key"))
        some = width > budget + 1 and not large.isEmpty()
        few = dealt.join(large, "key", "left_anti") if some else dealt
        walked = (
            few.repartition("key")
            .sortWithinPartitions("key", "rest")
            .mapInArrow(part(_forest, width=width, budget=budget, rows=4 * key_rows), "a long, b long")
        )
        found = walked if found is None else found.union(walked)
        if not some:
            return found
        rows = settle(dealt.join(large, "key", "left_semi"))


def _labelled(docs: DataFrame, words: int, seed: int, budget: int) -> DataFrame:
    """(doc_id, text_key, mark, root, component_id) for each row."""
    rows = settle(fingerprints(docs, words, seed))
    kinds = settle(rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id")))
    roots = components(fingerprint_links(kinds.select("mark"), budget))
    named = kinds.join(roots, kinds["mark"] == roots["node"], "left").select(kinds["mark"], F.coalesce("root", kinds["mark"]).alias("root"), "doc_id")
    ids = settle(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    labels = settle(named.select("mark", "root").join(ids, "root"))
    return rows.join(labels, "mark").select("doc_id", "text_key", "mark", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, seed: int = SEED, budget: int = BUDGET) -> DataFrame:
    """(doc_id, text_key, mark, component_id) for each row of documents(doc_id, text).

    component_id: the smallest doc_id reachable over linked fingerprints, its own included (null if
    every row of the component has a null doc_id). Null and empty texts have fingerprint 0 and link
    like any other. Repeated rows keep a row each. No rows give no rows.
    """
    return _labelled(docs, words, seed, budget).drop("root")


def hex_mark(column: str = "mark"):
    """16 lowercase hex digits of the 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex_mark().alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE, seed: int = SEED, budget: int = BUDGET) -> DataFrame:
    """The documents, one row of each near-duplicate component; columns as they were.

    The row of doc_id component_id stays; where several have that id (or none has one), the one of
    smallest text hash, and of rows equal in both the one whose columns have the smallest hash.
    """
    return first_of(docs, _labelled(docs, words, seed, budget))


def first_of(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The documents, one row of each root of labelled(doc_id, text_key, root, component_id), picked as in keep_one."""
    found = labelled.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("root").agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    kept = settle(first.select("doc_id", "text_key", "n"))
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("doc_id"), text_key().alias("text_key"))

    def among(rows: DataFrame) -> DataFrame:
        return packed.join(rows, packed["doc_id"].eqNullSafe(rows["doc_id"]) & (packed["text_key"] == rows["text_key"]), "left_semi")

    several = kept.where("n > 1")
    if several.isEmpty():
        return among(kept).select("doc.*")
    # rows that repeat an id and a text: a minimum, which is aggregated before the shuffle
    one = among(several).groupBy("doc_id", "text_key").agg(F.min_by("doc", F.xxhash64(*[F.col(f"doc.`{c}`") for c in docs.columns])).alias("doc"))
    return among(kept.where("n = 1")).select("doc.*").unionByName(one.select("doc.*"))
