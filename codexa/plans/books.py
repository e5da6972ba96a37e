"""Queries on book-shaped tables: conversations are books, their turns the parts, system turns non-linear; pages are resources of a site."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexa.operators import resources as rs
from codexa.session import table


def _parts(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("pos"), (F.col("role") != "system").alias("linear"), F.lit(True).alias("in_order"), "text")


PARTS_SQL = "SELECT conv_id AS book_id, turn AS pos, role <> 'system' AS linear, text FROM conversations"
TEXT_SQL = f"SELECT book_id, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE linear), '') AS text FROM ({PARTS_SQL}) GROUP BY book_id"


def reading_order_text(spark, sf):
    return rs.reading_text(_parts(spark, sf), "\n").select(F.col("book_id"), "text")


def reading_order_concat(spark, sf):
    return rs.reading_text(_parts(spark, sf)).select("book_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"))


def _resources(spark, sf):
    rows = table(spark, sf, "pages")
    site = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return rows.select(site.alias("book_id"), F.col("page_id").alias("pos"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.regexp_replace("url", "^[a-z]+://[^/?#]*", "").alias("href"))


RES_SQL = "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS book_id, page_id AS pos, 'p' || page_id AS id, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS href FROM pages"
KEY_SQL = f"SELECT *, CASE WHEN href = '' THEN '#' || pos WHEN rtrim(regexp_replace(regexp_extract(href, '^[^?#]*'), '/+', '/', 'g'), '/') = '' THEN CASE WHEN regexp_extract(href, '^[^?#]*') = '' THEN '.' ELSE '/' END ELSE rtrim(regexp_replace(regexp_extract(href, '^[^?#]*'), '/+', '/', 'g'), '/') END AS href_key FROM ({RES_SQL})"


def resource_dedup(spark, sf):
    return rs.unique_resources(_resources(spark, sf)).select("book_id", "pos", "id", "href_key")


def resource_alias(spark, sf):
    return rs.aliases(_resources(spark, sf)).select("book_id", "id", F.col("resource_pos").alias("resource_pos"))


def spine_canonical(spark, sf):
    res = _resources(spark, sf)
    order = res.select("book_id", "pos", F.col("pos").alias("resource_pos"), (F.col("pos") % 3 != 0).alias("linear"))
    return rs.canonical_order(order, res)


def manifest_join(spark, sf):
    res = _resources(spark, sf)
    entries = rs.unique_resources(res).where("pos % 2 = 0").select("book_id", F.col("href_key").alias("path"), F.col("pos").alias("size"))
    return rs.manifest(res, entries).select("book_id", "pos", "id", "size")


def spine_join(spark, sf):
    res = _resources(spark, sf)
    refs = res.select("book_id", "pos", F.col("id").alias("idref"), F.when(F.col("pos") % 4 == 0, "no").alias("linear_attr"))
    return rs.spine(refs, res.where("pos % 5 <> 0"))


def cover_pick(spark, sf):
    res = _resources(spark, sf)
    items = res.select("book_id", "pos", "id", F.when(F.col("pos") % 7 == 0, "svg cover-image").alias("properties"))
    metas = res.select("book_id", "pos", F.when(F.col("pos") % 2 == 0, "cover").otherwise("other").alias("name"), F.col("id").alias("content"))
    return rs.cover(items, metas)


def book_counts(spark, sf):
    parts = _parts(spark, sf)
    return rs.counts(parts, parts)


FIRST_SQL = f"WITH k AS ({KEY_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY book_id, href_key ORDER BY pos) AS r, min(pos) OVER (PARTITION BY book_id, href_key) AS first_pos FROM k)"

QUERIES = {
    "reading_order_text": (reading_order_text, TEXT_SQL),
    "reading_order_concat": (reading_order_concat, f"SELECT book_id, sha256(t) AS sha256, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT book_id, coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE linear), '') AS t FROM ({PARTS_SQL}) GROUP BY book_id)"),
    "resource_dedup": (resource_dedup, f"{FIRST_SQL} SELECT book_id, pos, id, href_key FROM f WHERE r = 1"),
    "resource_alias": (resource_alias, f"{FIRST_SQL} SELECT book_id, id, first_pos AS resource_pos FROM f WHERE r > 1"),
    "spine_canonical": (spine_canonical, f"{FIRST_SQL} SELECT book_id, pos, first_pos AS resource_pos, pos % 3 <> 0 AS linear FROM f"),
    "manifest_join": (manifest_join, f"{FIRST_SQL} SELECT f.book_id, f.pos, f.id, e.pos AS size FROM f JOIN (SELECT book_id, href_key, pos FROM f WHERE r = 1 AND pos % 2 = 0) e ON e.book_id = f.book_id AND e.href_key = (CASE WHEN f.href = '' THEN '.' ELSE f.href_key END)"),
    "spine_join": (spine_join, f"SELECT book_id, pos, pos AS resource_pos, pos % 4 <> 0 AS linear FROM ({RES_SQL}) WHERE pos % 5 <> 0"),
    "cover_pick": (cover_pick, f"SELECT book_id, coalesce(m, n) AS id FROM (SELECT book_id, min_by(id, pos) FILTER (WHERE pos % 7 = 0) AS m, min_by(id, pos) FILTER (WHERE pos % 2 = 0) AS n FROM ({RES_SQL}) GROUP BY book_id) WHERE m IS NOT NULL OR n IS NOT NULL"),
    "book_counts": (book_counts, f"SELECT book_id, count(*) AS n_resources, count(*) FILTER (WHERE linear) AS n_linear, count(*) FILTER (WHERE NOT linear) AS n_other FROM ({PARTS_SQL}) GROUP BY book_id"),
}
