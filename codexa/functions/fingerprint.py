"""MinHash and SimHash of texts, and their similarities.

Hashes are 64-bit patterns in a long. A batch's shingles are hashed side by
side: byte by byte over all of them for FNV-1a, seed by seed for MinHash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions.tokens import words

# Defaults and constants of the hashes.
N_HASHES, K = 128, 5
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
DEFAULT_SEED = 0x517CC1B727220A95
GOLDEN = 0x9E3779B97F4A7C15
SPLITMIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
FMIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
MASK = 2**64 - 1


def seeds(n: int, seed: int = 0) -> np.ndarray:
    """n numbers of the splitmix64 sequence; 0 stands for the default seed."""
    out, state = [], seed or DEFAULT_SEED
    for i in range(n):
        state = (state + GOLDEN) & MASK
        z = (state ^ (state >> 30)) * SPLITMIX[0] & MASK
        z = (z ^ (z >> 27)) * SPLITMIX[1] & MASK
        z ^= z >> 31
        out.append(z or (GOLDEN + i * 0x85EBCA6B) & MASK)
    return np.array(out, np.uint64)


def fnv1a(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a of each stretch of the data; longer ones first, so that a step works on a prefix of them."""
    order = np.argsort(-sizes, kind="stable")
    places, ordered = starts[order], -sizes[order]
    h = np.full(len(sizes), FNV_START, np.uint64)
    live = len(sizes)
    for i in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(ordered[:live], -i, side="left"))
        h[:live] = (h[:live] ^ data[places[:live] + i]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(FMIX[0])
    h ^= h >> np.uint64(33)
    h *= np.uint64(FMIX[1])
    h ^= h >> np.uint64(33)
    return h


def _word_ends(found: list[str], data: bytes) -> np.ndarray:
    """Where each word of a text ends, the words being joined by spaces."""
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(spaces) != len(found) - 1:  # folding can put a space into a word
        return np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in found]) - 1
    return np.append(spaces, len(data))


def _hashed(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts one after another, and how many each text has.

    A shingle is a stretch of the text's words joined by spaces, so no string is made for it.
    """
    parts, starts, stops, counts, at = [], [], [], [], 0
    for t in texts:
        found = words(t)
        n = max(1, len(found) - k + 1) if found else 0
        counts.append(n)
        if not n:
            continue
        data = " ".join(found).encode("utf-8", "replace")
        ends = _word_ends(found, data)
        starts.append(at + np.concatenate(([0], ends[: n - 1] + 1)))
        stops.append(at + ends[len(ends) - n :])
        parts.append(data)
        at += len(data)
    if not parts:
        return np.zeros(0, np.uint64), np.array(counts, np.int64)
    begins = np.concatenate(starts)
    return fnv1a(np.frombuffer(b"".join(parts), np.uint8), begins, np.concatenate(stops) - begins), np.array(counts, np.int64)


def minhash_all(h: np.ndarray, counts: np.ndarray, n: int = N_HASHES, seed: int = 0) -> np.ndarray:
    """A row of n minima (unsigned) for each text; all bits set for a text without shingles."""
    out = np.full((len(counts), n), MASK, np.uint64)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    for j, s in enumerate(seeds(n, seed) if len(full) else ()):
        out[full, j] = np.minimum.reduceat(_mixed(h ^ s), starts)
    return out


def simhash_all(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits for each text: 1 where more shingles have the bit than not; 0 without shingles."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    for bit in range(64 if len(full) else 0):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
        out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def _cut(texts: list, size: int = 2_000_000) -> Iterator[list]:
    held, total = [], 0
    for t in texts:
        if held and total + len(t or "") > size:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t or "")
    if held:
        yield held


def fingerprint(text: Column, minhash: bool = True, simhash: bool = True, n: int = N_HASHES, k: int = K, seed: int = 0, sim_k: int = K) -> Column:
    """struct<minhash array<long>, simhash long> of a text column; what is not asked for is null.

    Both are computed in one pass over the text; asking for neither means both. A null text has no
    fingerprint (null fields); an empty one has all bits set, and 0.
    """
    if not (minhash or simhash):
        minhash = simhash = True

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            mins, sims = [], []
            for texts in _cut(series.tolist()):
                h, counts = _hashed(texts, k)
                if minhash:
                    mins += list(minhash_all(h, counts, n, seed).view(np.int64))
                if simhash:
                    sims += simhash_all(*((h, counts) if sim_k == k else _hashed(texts, sim_k))).view(np.int64).tolist()
            empty = series.isna().tolist()
            yield pd.DataFrame(
                {
                    "minhash": pd.Series([None if e else x for e, x in zip(empty, mins, strict=True)] if minhash else [None] * len(series), dtype=object),
                    "simhash": pd.Series([None if e else x for e, x in zip(empty, sims, strict=True)] if simhash else [None] * len(series), dtype="Int64"),
                }
            )

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "minhash array<long>, simhash long")(text)


def minhash(text: Column, n: int = N_HASHES, k: int = K, seed: int = 0) -> Column:
    return fingerprint(text, simhash=False, n=n, k=k, seed=seed)["minhash"]


def simhash(text: Column, k: int = K) -> Column:
    return fingerprint(text, minhash=False, k=k, sim_k=k)["simhash"]


def jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 1 for two empty ones, 0 for unequal lengths."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(a) != F.size(b), 0.0).otherwise(same / F.size(a))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (64 - hamming(a, b)) / 64
