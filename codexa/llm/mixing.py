"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's
target over its size. Documents stand in a fixed order within their source; the
running sum of expected copies, moved by one random offset, crosses an integer
as often as the document is taken. Any run of documents is so taken in the right
proportion, and the order (by size, up and down in turn) keeps the words near
the target as well.

The running sum of a source is no single task's work: a source is cut into
chunks of about CHUNK rows by a hash, a chunk's sum starts where the counts of
the chunks before it end.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.llm.common import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that one task puts in order, about.
CHUNK = 4_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: list[float], share: float, most: float) -> dict[str | None, float]:
    """Words wanted from each source.

    Sources by code point, None last, get the weights in turn. Together they are to give `share` times
    all words, by weight; a target stops at `most` times its source's size and what is over goes to the
    rest by weight, again until none is above. All of it may stop: then the sum falls short.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weigh[s] for s in open_)
        over = [s for s in open_ if left * weigh[s] / total > most * sizes[s]] if total else open_
        if not over:
            return out | {s: left * weigh[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def place(doc_id: Column, digest: Column) -> Column:
    """60 bits that follow from a document's id and its text's MD5, as any database can compute them; null ids and texts count as empty."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(digest, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def offset(source: str | None, seed: int) -> float:
    """One number in [0, 1) for each source and seed."""
    return int.from_bytes(hashlib.sha256(repr((seed, source)).encode()).digest()[:6], "big") / 2**48


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 0, size: Column | None = None, digest: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """documents(doc_id, source, text, ...) -> (doc, size, source_size, target, copies), a row for each input row.

    doc is the whole input row as a struct, so that any column name is safe. size: words unless given;
    digest: the text's MD5 unless given.
    copies is at most `most` rounded up. Reruns agree: the order is by size, doc_id and a hash of the
    text; rows equal in all of these and in their source are interchangeable. Null sources form a source
    of their own; null ids and texts (size 0) are rows like any other; no rows give no rows. The driver
    holds one number for each source.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct("*").alias("doc"), F.col("source").alias("source"), F.col("doc_id").alias("id"), place(F.col("doc_id"), F.md5("text") if digest is None else digest).alias("h"), (n_words() if size is None else size).alias("size")
    )
    light = settle(rows.select("source", "h", "size"))
    stats = light.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    want = targets({r.source: r.s for r in stats}, weights, share, most)
    # by way of Arrow: rows of Python would start Python workers on the executors, which stay beside the next stage's
    plan = spark.createDataFrame(
        pa.Table.from_pylist(
            [{"source": r.source, "source_size": r.s, "target": want[r.source], "rate": want[r.source] / r.s if r.s else 0.0, "offset": offset(r.source, seed), "chunks": -(-r.n // chunk)} for r in stats],
            pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("rate", pa.float64()), ("offset", pa.float64()), ("chunks", pa.int64())]),
        )
    )

    # a source is two columns that are never null, so that the window and the join below deal rows out alike, once
    keys = ["named", "unnamed", "chunk"]

    def chunked(df: DataFrame) -> DataFrame:
        joined = df.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        return joined.withColumns({"named": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull(), "chunk": F.pmod("h", "chunks")})

    counts = chunked(light).groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("named", "unnamed").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    way = F.when(F.col("chunk") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    order = Window.partitionBy(*keys).orderBy(way, "id", "h")
    ranked = chunked(rows).withColumn("rank", F.row_number().over(order))
    bases = settle(bases)
    placed = ranked.join(bases, [ranked[k] == bases[f"{k}_"] for k in keys])
    crossed = lambda upto: F.floor(upto * F.col("rate") + F.col("offset"))
    at = F.col("base") + F.col("rank")
    return placed.select("doc", "size", "source_size", "target", (crossed(at) - crossed(at - 1)).alias("copies"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The documents as often as the mix takes them, columns as they were."""
    rows = mix(docs, **parameters).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


#: The contract's mix.
PRODUCTION = {"weights": [3.0, 1.0, 2.0], "share": 1.5, "most": 2.0}


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    light = settle(docs.select("doc_id", "source", F.md5("text").alias("digest"), n_words().alias("size")))
    rows = mix(light, size=F.col("size"), digest=F.col("digest"), **PRODUCTION)
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, (count(*) + CHUNK - 1) // CHUNK AS chunks FROM sized GROUP BY source
), weighed AS (
  SELECT source, s, chunks, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w FROM sources
), filled AS (
  SELECT *, 1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2.0::DOUBLE * s) OVER stopped, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER stopped, 0) AS open_w,
    row_number() OVER (ORDER BY 2.0::DOUBLE * s / w, source) AS k
  FROM weighed WINDOW stopped AS (ORDER BY 2.0::DOUBLE * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min(k) AS k, min_by(rest, k) AS rest, min_by(open_w, k) AS open_w FROM filled WHERE rest * w / open_w <= 2.0::DOUBLE * s
), wanted AS (
  SELECT f.source, f.s, f.chunks, CASE WHEN l.k IS NULL OR f.k < l.k THEN 2.0::DOUBLE * f.s ELSE l.rest * f.w / l.open_w END AS target FROM filled f, level l
), ranked AS (
  SELECT z.doc_id, z.size, w.s, w.target, CASE WHEN w.s = 0 THEN 0 ELSE w.target / w.s END AS rate,
    row_number() OVER (PARTITION BY z.source ORDER BY z.h % w.chunks, CASE WHEN z.h % w.chunks % 2 = 0 THEN z.size ELSE -z.size END, z.doc_id NULLS FIRST, z.h) AS r,
    CAST('0x' || substr(sha256(coalesce('(0, ''' || z.source || ''')', '(0, None)')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS o
  FROM sized z JOIN wanted w ON z.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, s AS source_size, target, CAST(coalesce(floor(r * rate + o) - floor((r - 1) * rate + o), 0) AS BIGINT) * size AS taken FROM ranked
""".replace("CHUNK", str(CHUNK))
