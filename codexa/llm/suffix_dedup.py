"""Removal of repeated byte strings by a Burrows-Wheeler transform whose intervals are expanded breadth-first.

Which bytes lie in a string of LENGTH bytes that starts elsewhere too is a
question over all documents at once, but no index over all of them is needed.

1.  Each start of a LENGTH-byte string gets the key of the string: the least
    hash of its K-byte pieces. Equal strings have equal keys wherever they
    stand. Neighbouring starts mostly share a key, so a document falls into
    runs of about 80 starts; only (key, hash of the run's bytes, place) travels.
2.  Keys of a single run drop out (a run that may repeat within
    itself stays). Runs of the same bytes are all repeats: they need no text,
    however many there are, and one of them stands for all.
3.  Keys with runs of different bytes get the text of one run of each. A task
    concatenates the runs of some keys, sorts the suffixes as deep as LENGTH,
    takes the Burrows-Wheeler transform and expands the intervals of all
    strings one byte to the left at a time, level by level. A level l shows the
    neighbours whose common prefix is l bytes; after level LENGTH - 1, what is
    not shown has LENGTH bytes or more in common.
4.  What is covered is merged for each document and cut out.

A key with more text than HOT is dealt out further. A passage that n documents
share gives n runs under one key that differ around it, and other hashes would
pick the passage again. But equal strings also have their least piece at the same
distance from their start: a run is cut by that distance into bins of 32, 8 and
at last 1 starts (WIDTHS), and the key becomes the hash of the bytes that all
strings of the bin have in common. Only keys that are still too large go on to
the next width; at width 1 all runs of a key are the same bytes. So no key's
distinct text in a task is over HOT, whatever the number of documents. Counts are
partial aggregates; the joins are equi-joins that adaptive execution may split.

Runs count as the same bytes if their key and the XXH3 of their bytes agree, 128
bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import as_bytes, part, pieces, settle, text_key

LENGTH = 200
#: Bytes of a hashed piece, a power of two.
K = 32
#: Text of one transform, and of a key beyond which the key is dealt out further: a key never fills a transform by itself.
BATCH = 2_000_000
HOT = BATCH // 4
#: Starts that stay together when a key is dealt out further, from one round to the next.
WIDTHS = (32, 8, 1)
#: Bits of a place within a block of starts, and the starts of a block.
PLACE = 23
BLOCK = 1 << 22
#: A byte that UTF-8 never has.
END = 0xFF


def piece_hashes(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each place (a polynomial by doubling, then mixed)."""
    h = (data.astype(np.uint64) + np.uint64(1 + seed)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    factor, n = 0x9E3779B97F4A7C15 + 2 * seed, 1
    while n < k:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor = factor * factor % 2**64
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def string_keys(data: np.ndarray, length: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For the string of `length` bytes at each place: the hash of its least piece, and where the piece is.

    Pieces are compared by their upper bits, the first of equal ones counts; so the choice, and the
    key, depend on the string's bytes alone. data holds up to 2 ** PLACE places.
    """
    hashes = piece_hashes(data, k, seed)
    least = (hashes >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    n, width = 1, length - k + 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < width:
        least = np.minimum(least[: n - width], least[width - n :])
    at = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    return hashes[at], at


def runs(data: np.ndarray, sizes: np.ndarray, length: int, k: int):
    """Texts one after another -> (text, start in data, number of starts, key, loop) of the runs of equal keys.

    loop: the least piece is not the same one all along, without which no string of the run repeats in it.
    """
    ends, found = np.cumsum(sizes), []
    for base in range(0, max(0, len(data) - length + 1), BLOCK):
        block = data[base : base + BLOCK + length - 1]
        keys, at = string_keys(block, length, k)
        places = base + np.arange(len(keys))
        owner = np.searchsorted(ends, places, side="right") if base else np.repeat(np.arange(len(sizes)), sizes)[: len(keys)]
        inside = places + length <= ends[owner]
        new = np.ones(len(keys) + 1, bool)
        new[1:-1] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(new)
        starts, stops = edges[:-1], edges[1:]
        good = inside[starts]
        starts, stops = starts[good], stops[good]
        found.append((owner[starts], base + starts, stops - starts, keys[starts], at[starts] != at[stops - 1]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in pieces(batches, "text", 2_000_000):
        texts = as_bytes(batch.column("text"))
        raw, sizes = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        doc, starts, counts, keys, loops = runs(np.frombuffer(raw, np.uint8), sizes, length, k)
        stops = (starts + counts + length - 1).tolist()
        sigs = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), stops, strict=True)), np.uint64, len(stops))
        rows, base = pa.array(doc), np.cumsum(sizes) - sizes
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.view(np.int64)), pa.array(sigs.view(np.int64)), batch.column("doc_id").take(rows), batch.column("text_key").take(rows),
                pa.array((starts - base[doc]).astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(loops.astype(np.int32)),
            ],
            ["key", "sig", "doc_id", "text_key", "start", "count", "loop"],
        )


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the `depth` bytes or more that follow (cyclic, ties in any order), and where the first 8 of them change."""
    n, head, width = len(text), text.astype(np.uint64), 1
    while width < 8:
        head = (head << np.uint64(8 * width)) | np.roll(head, -width)
        width *= 2
    places = np.argsort(head)
    new = np.ones(n, bool)
    new[1:] = head[places][1:] != head[places][:-1]
    first = new.copy()
    rank = np.empty(n, np.int64)
    rank[places] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while width < depth:
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            break
        own = places[slots]
        key = rank[own] * n + rank[(own + width) % n]
        order = np.argsort(key)
        own, key = own[order], key[order]
        places[slots] = own
        change = np.ones(len(key), bool)
        change[1:] = key[1:] != key[:-1]
        new[slots] = change
        rank[own] = slots[np.maximum.accumulate(np.where(change, np.arange(len(key)), 0))]
        width *= 2
    return places, first


def repeated_places(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes (at least 8) at each place stand at another place too; text is cyclic.

    An interval [lo, hi] of sorted suffixes holds those that begin with one string. For each byte that
    stands before them, the transform's steps map the interval to that of the string with the byte in
    front. An interval goes on only if it shows a new end, so each of the text's places is shown once.
    The packed sort gives the intervals of 8 bytes to begin with.
    """
    n = len(text)
    places, first = sorted_suffixes(text, length)
    before = text[places - 1]
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    shown = np.zeros(n + 1, bool)
    lo = np.flatnonzero(first)
    shown[lo] = shown[n] = True
    hi = np.append(lo[1:], n) - 1
    for _ in range(8, length):
        one = lo == hi
        narrow = step[lo[one]]
        lo, hi = lo[~one], hi[~one]
        sizes = hi - lo + 1
        owner = np.repeat(np.arange(len(lo)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[owner]
        kind = owner * 256 + before[at]
        order = np.argsort(kind, kind="stable")
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = kind[order][1:] != kind[order][:-1]
        edge = np.flatnonzero(edge)
        steps = step[at[order]]
        lo, hi = np.concatenate((narrow, steps[edge[:-1]])), np.concatenate((narrow, steps[edge[1:] - 1]))
        fresh = ~shown[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        shown[hi + 1] = True
        if not len(lo):
            break
    pairs = np.flatnonzero(~shown[1:n])
    out = np.zeros(n, bool)
    out[places[pairs]] = out[places[pairs + 1]] = True
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _expand(batches: Iterator[pa.RecordBatch], length: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> (doc_id, text_key, start, stop) covered by strings that start elsewhere too."""
    groups: list[dict[bytes, list]] = []
    loops: list[bool] = []
    held, key, kinds = 0, None, None

    def out() -> pa.RecordBatch:
        found = []
        whole = [s for g, loop in zip(groups, loops, strict=True) if len(g) > 1 or loop for s in g]
        text = np.frombuffer(b"".join(s + bytes([END]) for s in whole), np.uint8)
        flags, at = repeated_places(text, length) if len(text) else None, 0
        for group, loop in zip(groups, loops, strict=True):
            tested = len(group) > 1 or loop
            for run, owners in group.items():
                count = len(run) - length + 1
                if sum(o[0] for o in owners) > 1:
                    stretches = [(0, count - 1)]
                else:
                    stretches = _spans(flags[at : at + count]) if tested else []
                at += (len(run) + 1) * tested
                # a run that stood for several is known to be repeated as a whole
                found += [(o[1], o[2], o[3] + a, o[3] + b + length) for o in owners if o[0] == 1 for a, b in stretches]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "text_key", "start", "stop"])

    for batch in batches:
        kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32()]
        columns = [batch.column(c).to_pylist() for c in ("key", "n", "doc_id", "text_key", "start", "loop", "run")]
        for k, n, doc, text, start, loop, run in zip(*columns, strict=True):
            if k != key:
                if held >= limit:
                    yield out()
                    groups, loops, held = [], [], 0
                groups.append({})
                loops.append(False)
                key = k
            if run not in groups[-1]:
                groups[-1][run] = []
                held += len(run)
            groups[-1][run].append((n, doc, text, start))
            loops[-1] |= bool(loop)
    if groups:
        yield out()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shrink = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([shrink.compress(t) for t in as_bytes(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), packed], ["doc_id", "text_key", "packed"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents with the runs wanted of them -> a row (key, n, doc_id, text_key, start, loop, run, hot) for each."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, found, names = [], [], ("key", "n", "start", "loop", "hot")
        columns: dict[str, list] = {c: [] for c in names}
        for i, (packed, wanted) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
            text = expand.decompress(packed)
            for w in wanted:
                rows.append(i)
                found.append(text[w["start"] : w["start"] + w["count"] + length - 1])
                for c in names:
                    columns[c].append(w[c])
        rows = pa.array(rows, pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        made = {c: pa.array(columns[c], t) for c, t in zip(names, kinds, strict=True)}
        made |= {"doc_id": batch.column("doc_id").take(rows), "text_key": batch.column("text_key").take(rows), "run": pa.array(found, pa.binary())}
        order = ["key", "n", "doc_id", "text_key", "start", "loop", "run", "hot"]
        yield pa.RecordBatch.from_arrays([made[c] for c in order], order)


def binned(data: np.ndarray, sizes: np.ndarray, length: int, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs one after another -> (run, start in data, number of starts, start of the common bytes) of their parts.

    The strings of a part have the same least piece, at distances of one bin of `width`; the common
    bytes are the length - width + 1 that any string with a distance in the bin has.
    """
    ends = np.cumsum(sizes)
    _, at = string_keys(data, length, k)
    places = np.arange(len(at))
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    inside = places + length <= ends[owner]
    bins = (at - places) // width
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (at[1:] != at[:-1]) | (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(new)
    starts, stops = edges[:-1], edges[1:]
    good = inside[starts]
    starts, stops = starts[good], stops[good]
    return owner[starts], starts, stops - starts, at[starts] - bins[starts] * width


def _deal(batches: Iterator[pa.RecordBatch], length: int, k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (n, doc_id, text_key, start, run) -> (key, sig, n, doc_id, text_key, start, count, known, run) of the runs' parts.

    A part that a run holds several times, as a line of dashes does, is known to be repeated: it goes on
    once, for two, and its other places are rows without a run, neighbouring ones as one.
    """
    digest = xxhash.xxh3_64_intdigest
    for batch in pieces(batches, "run", 1_000_000):
        texts = batch.column("run").to_pylist()
        raw, sizes = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        run, starts, counts, cores = binned(np.frombuffer(raw, np.uint8), sizes, length, k, width)
        stops = starts + counts + length - 1
        keys = np.fromiter((digest(raw[c : c + length - width + 1], width) for c in cores.tolist()), np.uint64, len(starts))
        sigs = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
        _, first, group, seen = np.unique(np.stack([run.astype(np.uint64), keys, sigs]), axis=1, return_index=True, return_inverse=True, return_counts=True)
        known = seen[group.ravel()] > 1
        head = np.zeros(len(starts), bool)
        head[first] = True
        # places of known parts: one row for neighbours that overlap
        rest = np.flatnonzero(known)
        new = np.ones(len(rest) + 1, bool)
        new[1:-1] = (run[rest][1:] != run[rest][:-1]) | (starts[rest][1:] > stops[rest][:-1])
        edges = np.flatnonzero(new)
        left, right = rest[edges[:-1]], rest[edges[1:] - 1]
        base = np.cumsum(sizes) - sizes
        at = batch.column("start").to_numpy()
        whole = np.flatnonzero(head)
        owner = np.concatenate((run[whole], run[left]))
        begin = np.concatenate((starts[whole], starts[left]))
        count = np.concatenate((counts[whole], stops[right] - starts[left] - length + 1))
        n = batch.column("n").to_numpy()
        rows, none = pa.array(owner), np.zeros(len(left), bool)
        gone = np.concatenate((np.zeros(len(whole), bool), np.ones(len(left), bool)))
        number = lambda x: pa.array(np.concatenate((x[whole].view(np.int64), none)), pa.int64(), mask=gone)
        held = [raw[a:b] for a, b in zip(starts[whole].tolist(), stops[whole].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                number(keys), number(sigs), pa.array(np.concatenate((np.where(known[whole], 2, n[run[whole]]), none + 1)).astype(np.int32)),
                batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array((at[owner] + begin - base[owner]).astype(np.int32)),
                pa.array(count.astype(np.int32)), pa.array(gone), pa.array([*held, *[None] * len(left)], pa.binary()),
            ],
            ["key", "sig", "n", "doc_id", "text_key", "start", "count", "known", "run"],
        )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _remove(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes, gone, counts, kept = [], [], [], []
        for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text = expand.decompress(packed)
            cover = merged([(s["start"], s["stop"]) for s in spans or ()])
            sizes.append(len(text))
            gone.append(sum(b - a for a, b in cover))
            counts.append(len(cover))
            edges = [0, *[x for span in cover for x in span], len(text)]
            left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            kept.append(hashlib.sha256(left).hexdigest() if digest else left)
        numbers = [pa.array(x, pa.int64()) for x in (sizes, gone, counts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *numbers, pa.array(kept, pa.string() if digest else pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"],
        )


def _place() -> Column:
    return F.xxhash64("doc_id", "text_key", "start")


def _stop(length: int) -> Column:
    return (F.col("start") + F.col("count") + (length - 1)).alias("stop")


def dealt(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, text) -> spans known to be repeated as a whole, and the rows (key, n, doc_id, text_key, start, loop, run) to expand by key.

    A key's runs have at most `hot` bytes. n is 2 for a run that stands for several.
    """
    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    kind = dict(keyed.dtypes)["doc_id"]
    all_runs = keyed.mapInArrow(part(_runs, length=length, k=k), f"key long, sig long, doc_id {kind}, text_key long, start int, count int, loop int")
    again = all_runs.groupBy("key").agg(F.count("*").alias("n"), F.max("loop").alias("loop")).where("n > 1 OR loop > 0").select("key")
    some = settle(all_runs.join(again, "key", "left_semi"))
    sums = settle(some.groupBy("key", "sig").agg(F.count("*").alias("n"), F.min(_place()).alias("first"), F.max("count").alias("c"), F.max("loop").alias("loop")))
    many = settle(
        sums.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("c") + length).alias("size"), F.max("loop").alias("loop"))
        .where("kinds > 1 OR loop > 0").select("key", (F.col("size") > hot).alias("hot"))
    )
    whole = some.join(sums.where("n > 1").select("key", "sig"), ["key", "sig"]).select("doc_id", "text_key", "start", _stop(length))
    asked = sums.join(many, "key").select("key", "sig", F.least("n", F.lit(2)).cast("int").alias("n"), "first", "hot")
    wanted = some.join(asked, ["key", "sig"]).where(_place() == F.col("first")).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("key", "n", "start", "count", "loop", "hot")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "wanted")
    packed = pack(docs)
    texts = packed.join(wanted, packed["doc_id"].eqNullSafe(wanted["id_"]) & (packed["text_key"] == wanted["key_"])).select("doc_id", "text_key", "packed", "wanted")
    cut = texts.mapInArrow(part(_cut, length=length), f"key long, n int, doc_id {kind}, text_key long, start int, loop int, run binary, hot boolean")
    if many.where("hot").isEmpty():
        return whole, cut.drop("hot")
    cut = settle(cut)
    rows, large = cut.where("NOT hot").drop("hot"), cut.where("hot")
    for width in WIDTHS:
        # a run that stood for several is reported already: only what is new below counts as an owner
        parts = settle(large.mapInArrow(part(_deal, length=length, k=k, width=width), f"key long, sig long, n int, doc_id {kind}, text_key long, start int, count int, known boolean, run binary"))
        whole = whole.union(parts.where("known").select("doc_id", "text_key", "start", _stop(length)))
        parts = parts.where("NOT known").drop("known")
        sums = settle(parts.groupBy("key", "sig").agg(F.sum("n").alias("n"), F.min(_place()).alias("first"), F.max("count").alias("c")))
        whole = whole.union(parts.where("n = 1").join(sums.where("n > 1").select("key", "sig"), ["key", "sig"]).select("doc_id", "text_key", "start", _stop(length)))
        many = sums.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("c") + length).alias("size")).where("kinds > 1").select("key", (F.col("size") > hot).alias("hot"))
        asked = sums.join(many, "key").select("key", "sig", F.least("n", F.lit(2)).cast("int").alias("n"), "first", "hot")
        chosen = parts.drop("n").join(asked, ["key", "sig"]).where(_place() == F.col("first"))
        kept = settle(chosen.select("key", "n", "doc_id", "text_key", "start", F.lit(0).alias("loop"), "run", "hot"))
        rows, large = rows.union(kept.where("NOT hot").drop("hot")), kept.where("hot")
        if large.isEmpty():
            break
    return whole, rows


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, text_key, start, stop), bytes of `length`-byte strings that start elsewhere too.

    Spans may overlap. Texts shorter than `length` (null ones too) have none. Of two equal rows each
    is elsewhere to the other. No rows give no rows.
    """
    whole, rows = dealt(docs, length, k, hot)
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(part(_expand, length=length, limit=batch), f"doc_id {kind}, text_key long, start int, stop int")
    return whole.union(found)


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, packed): texts compressed for a shuffle; null counts as empty."""
    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    return keyed.mapInArrow(_pack, f"doc_id {dict(keyed.dtypes)['doc_id']}, text_key long, packed binary")


def remove_repeated(docs: DataFrame, digest: bool = False, **parameters) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept), a row for each input row.

    n_spans: maximal runs of removed bytes. kept: the bytes that are left (they may cut a character);
    with `digest`, kept_sha256 instead.
    """
    kind = dict(docs.dtypes)["doc_id"]
    spans = repeated_spans(docs, **parameters).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "spans")
    packed = pack(docs)
    rows = packed.join(spans, packed["doc_id"].eqNullSafe(spans["id_"]) & (packed["text_key"] == spans["key_"]), "left").select("doc_id", "packed", "spans")
    return rows.mapInArrow(part(_remove, digest=digest), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes that each document loses, and a digest of what is left."""
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
