"""Connected components as DataFrames: alternating large-star and small-star steps.

Every step is a grouped minimum (partially aggregated, so a hub is no hot key)
and an equi-join of settled tables (which adaptive execution may split), and is
settled in the shared folder. Links are never gathered on the driver; it only compares a count
and a checksum to see whether a step has changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = settle(edges.groupBy("hi").agg(F.min("lo").alias("m")))
    met = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return met.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b), long, in any direction -> (node, root) for every node with a link to another one.

    root is the smallest node of the component; a root has no row of its own.
    Loops and repeated links are fine; null ends are ignored; no link gives no row.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = _mark(edges)
    while True:
        edges = settle(_small_star(settle(_large_star(edges))))
        was, mark = mark, _mark(edges)
        if mark == was:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
