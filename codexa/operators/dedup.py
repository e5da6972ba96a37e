"""Set-level duplicates: equal texts, and near ones by SimHash or MinHash.

Equal texts and equal fingerprints are collapsed to a representative before any
join, so copies cost one row. Candidates come from equi-joins on keys of many
bits: of six blocks of a SimHash, two fingerprints that differ in at most three
bits agree on three, which gives twenty keys of about 32 bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.functions.fingerprint import hamming, jaccard

BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Bits of three blocks at most; a key has the number of its table above them.
KEY_BITS = 33


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(sha256, n, first): texts that several documents have."""
    rows = docs.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return rows.where("n > 1")


def simhash_classes(marks: DataFrame) -> DataFrame:
    """(doc_id, simhash) -> (simhash, doc_id, n): the smallest document of each fingerprint."""
    return marks.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def simhash_members(marks: DataFrame) -> DataFrame:
    """(doc_id, simhash) -> (doc_id, class_id, n): each document's representative and the size of its class; no fingerprint is one class."""
    classes = simhash_classes(marks).select(F.col("simhash").alias("own"), F.col("doc_id").alias("class_id"), "n")
    return marks.join(classes, F.col("simhash").eqNullSafe(F.col("own"))).select("doc_id", "class_id", "n")


def simhash_pairs(marks: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance): representatives of fingerprints that differ in 1 to `distance` bits (3 at most)."""
    if not 0 < distance <= 3:
        raise ValueError("six blocks find distances up to 3")
    classes = simhash_classes(marks)
    bits = lambda at, n: F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << n) - 1))
    keys = []
    for i, three in enumerate(combinations(BLOCKS, 3)):
        key, at = F.lit(i << KEY_BITS).cast("long"), 0
        for start, n in three:
            key, at = key.bitwiseOR(F.shiftleft(bits(start, n), at)), at + n
        keys.append(key)
    dealt = classes.select("simhash", "doc_id", F.explode(F.array(*keys)).alias("key"))
    left = dealt.select("key", F.col("simhash").alias("x"), F.col("doc_id").alias("a"))
    right = dealt.select("key", F.col("simhash").alias("y"), F.col("doc_id").alias("b"))
    # the planner takes twenty keys a row for one; by that estimate it would send all of them to the driver and to every task
    near = left.hint("merge").join(right.hint("merge"), "key").where(F.col("a") < F.col("b")).withColumn("distance", hamming(F.col("x"), F.col("y"))).where(F.col("distance") <= distance)
    # a pair meets on every key it shares; it is taken on the first
    first = F.array_min(F.transform(F.array(*[F.when(_agree(three), F.lit(i)) for i, three in enumerate(combinations(BLOCKS, 3))]), lambda x: F.coalesce(x, F.lit(99))))
    return near.where(F.shiftright("key", KEY_BITS) == first).select("a", "b", F.col("distance").cast("long").alias("distance"))


def _agree(blocks):
    mask = sum(((1 << n) - 1) << at for at, n in blocks)
    mask = mask - 2**64 if mask >= 2**63 else mask
    return F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit(mask)) == 0


def minhash_pairs(signatures: DataFrame, bands: int = 16, least: float = 0.8) -> DataFrame:
    """(doc_id, minhash) -> (a, b, jaccard): representatives of equal signatures whose estimate is `least` or more.

    A band is some hashes in a row; pairs that agree on a band are compared in full. There are at least `bands`, and
    one more than the places in which such a pair may differ, so that it agrees on one of them.
    """
    classes = signatures.where(F.col("minhash").isNotNull()).groupBy("minhash").agg(F.min("doc_id").alias("doc_id"))
    size = F.size("minhash")
    differ = F.floor(size * (1 - least) + 1e-9).cast("int")
    n = F.greatest(F.lit(1), F.least(size, F.greatest(F.lit(bands), differ + 1)))
    edge = lambda i: F.floor(i * size / n).cast("int")
    band = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice("minhash", edge(i) + 1, edge(i + 1) - edge(i))).alias("h")))
    keys = classes.select("doc_id", F.explode(band).alias("key"))
    pairs = keys.alias("l").join(keys.alias("r"), "key").where("l.doc_id < r.doc_id").select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()
    one = classes.select(F.col("doc_id").alias("a"), F.col("minhash").alias("x"))
    two = classes.select(F.col("doc_id").alias("b"), F.col("minhash").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", jaccard(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") >= least)


def containment(items: DataFrame, docs: DataFrame) -> DataFrame:
    """items(item_id, shingles), docs(doc_id, shingles) -> (item_id, doc_id, shared, share): shingles of an item that a document has."""
    own = items.select("item_id", F.size(F.array_distinct("shingles")).alias("n"), F.explode(F.array_distinct("shingles")).alias("s"))
    theirs = docs.select("doc_id", F.explode(F.array_distinct("shingles")).alias("s"))
    return own.join(theirs, "s").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("shared")).select("item_id", "doc_id", "shared", (F.col("shared") / F.col("n")).alias("share"))
