"""Near copies by the Jaccard similarity of their word shingles, checked exactly.

Two texts whose five-word shingles have a similarity of 0.8 differ in 10 of 64
SimHash bits on average and in over 3 nearly always, and no trie prunes at a
budget of 20. So SimHash with the trie self-join only finds the closest copies
here; MinHash bands find the rest. With 24 bands of 4 a pair of similarity 0.8
misses all of them once in 300,000. Every candidate is verified on its shingles.

In a bucket every set is first compared with the smallest, then, where the bucket
still holds several components, with a leader from another of them; that settles
a dense group at a few comparisons a member. Buckets that stay open are compared
across components, in blocks of SHINGLES, and only links that join two components
leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import part, pieces, release, settle, text_key
from codexa.llm.components import components
from codexa.llm.simhash_dedup import SEED, bit_counts, fingerprint_links

SHINGLE = 5
#: Links are pairs of this similarity or more, as a fraction.
LEAST = (4, 5)
BANDS, WIDTH = 24, 4
#: Rounds of comparisons with one leader a bucket.
LEADERS = 2
#: Shingles of the sets that a task compares at once, about; a bucket with more is compared block by block.
SHINGLES = 2_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(SEED).integers(1, 2**64 - 1, size=(2, BANDS * WIDTH), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, one text after another and sorted within it; how many each has.

    Words are split at ASCII white space, A-Z lowered. A text of fewer words has one shingle, its whole sequence;
    a null text or one without words has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = split.flatten()
    owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    hashes, owner = known[coded.indices.to_numpy(zero_copy_only=False)][full], owner[full]
    lengths = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(lengths) - lengths
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        rolled = rolled * _FACTOR + hashes[i : i + len(rolled)]
    at = np.arange(len(rolled))
    inside = at + words <= (starts + lengths)[owner[: len(rolled)]] if len(rolled) else np.zeros(0, bool)
    codes, docs = _mixed(rolled[inside]), owner[: len(rolled)][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < words))
    if len(short):
        whole = [xxhash.xxh64_intdigest(hashes[starts[i] : starts[i] + lengths[i]].tobytes(), SEED) for i in short.tolist()]
        codes, docs = np.concatenate((codes, np.array(whole, np.uint64))), np.concatenate((docs, short))
        order = np.argsort(docs, kind="stable")
        codes, docs = codes[order], docs[order]
    edges = np.searchsorted(docs, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        codes[a:b].sort()
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])
    return codes[new], np.bincount(docs[new], minlength=len(texts))


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    codes, sizes = shingle_sets(texts, words)
    return np.split(codes, np.cumsum(sizes)[:-1]) if len(sizes) else []


def signatures(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set the least of its hashes under each of the multipliers; all bits set without hashes."""
    out = np.full((len(sizes), BANDS * WIDTH), 2**64 - 1, np.uint64)
    some = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[some]
    for i, (mask, factor) in enumerate(_SEEDS.T if len(some) else ()):
        out[some, i] = np.minimum.reduceat((codes ^ mask) * (factor | np.uint64(1)), begins)
    return out


def bands(mins: np.ndarray) -> np.ndarray:
    """Each set's key in each band, as a long."""
    grouped = mins.reshape(len(mins), BANDS, WIDTH)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] * _FACTOR
    for i in range(WIDTH):
        keys = _mixed((keys + grouped[:, :, i]) * _FACTOR)
    return keys.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        codes, sizes = shingle_sets(batch.column("text"), words)
        own = np.split(codes, np.cumsum(sizes)[:-1]) if len(sizes) else []
        marks = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in own], np.uint64)
        prints = np.array([int.from_bytes(np.packbits(bit_counts(x) * 2 > len(x)).tobytes(), "big") for x in own], np.uint64)
        keys = bands(signatures(codes, sizes))
        offsets = pa.array(np.arange(len(own) + 1) * BANDS, pa.int32())
        out = [
            batch.column("doc_id"), batch.column("text_key"), pa.array(marks.view(np.int64)), pa.array(prints.view(np.int64)),
            pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
        ]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "mark", "print", "size", "bands"])
        release()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have the similarity asked for; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def _verified(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(iter([whole]), "right"):
            coded = batch.column("left").dictionary_encode()
            left, number = _sets(coded.dictionary, words), coded.indices.to_pylist()
            right = _sets(batch.column("right"), words)
            keep = [similar(left[n], r) for n, r in zip(number, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _joined(marks: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links between rows of different labels that are similar, one at most for each label that they join to another."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    _, group = np.unique(labels, return_inverse=True)
    # rows that share most with others come first: what they join need not be compared again
    common = np.bincount(ids)
    fame = np.add.reduceat(common[ids], np.minimum(begins, max(0, len(ids) - 1))) if len(ids) else np.zeros(len(sets))
    left = np.argsort(-fame, kind="stable")
    held = np.zeros(len(common) + 1, np.int64)
    a, b = [], []
    while len(left) > 1:
        i, left = left[0], left[1:]
        others = left[group[left] != group[i]]
        if not len(others):
            if (group[left] == group[i]).all():
                break
            continue
        near = others[(np.minimum(sizes[others], sizes[i]) * LEAST[1] >= np.maximum(sizes[others], sizes[i]) * LEAST[0])]
        if not len(near):
            continue
        own = ids[begins[i] : begins[i] + sizes[i]]
        held[own] = 1
        count = sizes[near]
        at = np.repeat(begins[near] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(np.repeat(np.arange(len(near)), count), weights=held[ids[at]], minlength=len(near)).astype(np.int64)
        held[own] = 0
        for j in near[both * LEAST[1] >= (count + sizes[i] - both) * LEAST[0]].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                a.append(marks[i])
                b.append(marks[j])
    return a, b


def _between(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, mark, label, text) sorted by key -> verified links (a, b) that connect what is linked within a key, beyond its labels."""

    def links(rows):
        a, b = _joined(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held, key = [], None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "mark", "label"))
        for k, mark, label, own in zip(*columns, _sets(batch.column("text"), words), strict=True):
            if k != key and held:
                yield links(held)
                held = []
            key = k
            held.append((mark, label, own))
    if held:
        yield links(held)


def _links(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    left, right = texts.select(F.col("mark").alias("a"), F.col("text").alias("left")), texts.select(F.col("mark").alias("b"), F.col("text").alias("right"))
    return settle(settle(pairs.where("a <> b").distinct()).join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(part(_verified, words=words), "a long, b long"))


def _open(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, mark, size, label) of the buckets that hold several components."""
    named = settle(met.join(roots, met["mark"] == roots["node"], "left").select("key", "mark", "size", F.coalesce("root", "mark").alias("label")))
    several = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    return settle(named.join(several, "key", "left_semi"))


def labelled(docs: DataFrame, words: int = SHINGLE, shingles: int = SHINGLES) -> DataFrame:
    """(doc_id, text_key, mark, root, component_id) for each row of documents(doc_id, text).

    A mark is a set of shingles; a root stands for the marks that similar pairs connect. Null and
    empty texts have the empty set. component_id is the smallest doc_id with the root. Repeated rows
    each have a row; no rows give no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_key long, mark long, print long, size int, bands array<long>"
    rows = settle(docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(part(_sketches, words=words), schema))
    prints = settle(rows.groupBy("print").agg(F.min("mark").alias("mark")))
    tried = settle(fingerprint_links(prints.select(F.col("print").alias("mark"))).distinct())
    marks = prints.select(F.col("print").alias("p"), F.col("mark").alias("m"))
    close = tried.join(marks, tried["a"] == marks["p"]).select(F.col("m").alias("x"), "b").join(marks, F.col("b") == marks["p"]).select(F.col("x").alias("a"), F.col("m").alias("b"))
    dealt = rows.select("mark", "size", F.explode("bands").alias("key"))
    leaders = dealt.groupBy("key").agg(F.min("mark").alias("a"), F.max("mark").alias("z")).where("a < z").select("key", "a")
    met = settle(dealt.join(leaders, "key").distinct())
    near = settle(met.select("mark").union(close.select("a")).union(close.select("b")).distinct())
    one = rows.join(near, "mark", "left_semi").groupBy("mark").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("mark", F.col("x.doc_id").alias("i"), F.col("x.text_key").alias("k"))
    found = docs.select("doc_id", "text", text_key().alias("text_key")).join(settle(one), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")))
    texts = settle(found.select("mark", "text").dropDuplicates(["mark"]))
    links = _links(close.union(met.select("a", F.col("mark").alias("b"))), texts, words)
    roots = settle(components(links))
    open_ = _open(met.select("key", "mark", "size"), roots)
    for _ in range(LEADERS - 1):
        if open_.isEmpty():
            break
        # the next leader is of the largest component by label, compared with the members of others
        lead = settle(open_.groupBy("key").agg(F.max(F.struct("label", "mark")).alias("z")).select("key", F.col("z.mark").alias("a"), F.col("z.label").alias("of")))
        links = settle(links.union(_links(open_.join(lead, "key").where("label <> of").select("a", F.col("mark").alias("b")), texts, words)))
        roots = settle(components(links))
        open_ = _open(open_.select("key", "mark", "size"), roots)
    if not open_.isEmpty():
        # a bucket of several blocks is compared as pairs of blocks; a member goes to each pair that its block is in
        blocks = settle(open_.groupBy("key").agg(F.ceil(F.sum("size") / shingles).cast("int").alias("n")))
        own = F.pmod(F.xxhash64("mark"), F.col("n"))
        spread = open_.join(blocks, "key").select("key", "mark", "label", own.alias("p"), F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1)).alias("q"))
        keyed = spread.select(F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("key"), "mark", "label")
        between = keyed.join(texts, "mark").select("key", "mark", "label", "text").repartition("key").sortWithinPartitions("key", "mark")
        more = between.mapInArrow(part(_between, words=words), "a long, b long")
        roots = settle(components(links.union(settle(more))))
    kinds = rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    rooted = settle(kinds.join(roots, kinds["mark"] == roots["node"], "left").select(kinds["mark"], F.coalesce("root", kinds["mark"]).alias("root"), "doc_id"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = settle(rooted.select("mark", "root").join(ids, "root"))
    return rows.select("doc_id", "text_key", "mark").join(labels, "mark").select("doc_id", "text_key", "mark", "root", "component_id")
