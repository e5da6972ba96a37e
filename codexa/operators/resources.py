"""Resources and reading orders of books, as DataFrame operators.

resources(book_id, pos, id, href, media_type, ...), reading_order(book_id, pos,
resource_pos, linear). A book's rows are few; books are many, so every operator
partitions by book.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions.strings import clean_href, is_text


def manifest(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifest items(book_id, pos, id, href, ...) that have a stored entry(book_id, path, size)."""
    return items.withColumn("path", clean_href(F.col("href"))).join(entries, ["book_id", "path"])


def spine(itemrefs: DataFrame, items: DataFrame) -> DataFrame:
    """itemrefs(book_id, pos, idref, linear_attr) to items by id; linear unless the attribute is 'no'."""
    known = items.select("book_id", F.col("id").alias("idref"), F.col("pos").alias("resource_pos"))
    linear = F.coalesce(F.col("linear_attr"), F.lit("")) != "no"
    return itemrefs.join(known, ["book_id", "idref"]).select("book_id", "pos", "resource_pos", linear.alias("linear"))


def deduped(resources: DataFrame) -> DataFrame:
    """One resource for each clean href of a book, the first by pos; resources without an href all stay."""
    key = F.when(F.coalesce(F.col("href"), F.lit("")) == "", F.concat(F.lit("#"), F.col("pos").cast("string"))).otherwise(clean_href(F.col("href")))
    first = Window.partitionBy("book_id", "href_key").orderBy("pos", "id")
    return resources.withColumn("href_key", key).withColumn("first_pos", F.first("pos").over(first)).withColumn("is_first", F.row_number().over(first) == 1)


def unique_resources(resources: DataFrame) -> DataFrame:
    return deduped(resources).where("is_first").drop("is_first", "first_pos")


def aliases(resources: DataFrame) -> DataFrame:
    """(book_id, id, resource_pos): ids of dropped resources that no kept one has, and the resource they mean."""
    rows = deduped(resources)
    kept = rows.where("is_first").select("book_id", F.col("id").alias("kept_id"))
    dropped = rows.where("NOT is_first AND id <> ''").groupBy("book_id", "id").agg(F.min_by("first_pos", "pos").alias("resource_pos"))
    return dropped.join(kept, (dropped["book_id"] == kept["book_id"]) & (dropped["id"] == kept["kept_id"]), "left_anti")


def canonical_ids(resources: DataFrame) -> DataFrame:
    """unique_resources() with ids made unique in their book: one that an earlier resource has becomes id__dupN, N the smallest that is free.

    An id that a dropped resource had is taken as well. Within a book the rule is sequential; a book's rows are few.
    """
    rows = deduped(resources)
    own = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit("")).alias("id"), "is_first"))).alias("rows"))

    def run(books: pd.Series) -> pd.Series:
        return books.map(_free_ids)

    named = own.select("book_id", F.explode(F.pandas_udf(run, "array<struct<pos:long,id:string>>")("rows")).alias("n")).select("book_id", F.col("n.pos").alias("pos"), F.col("n.id").alias("new_id"))
    return rows.where("is_first").drop("is_first", "first_pos").join(named, ["book_id", "pos"]).withColumn("id", F.col("new_id")).drop("new_id")


def _free_ids(rows) -> list[dict]:
    taken: set[str] = set()
    out = []
    for r in rows:
        name, n = r["id"], 1
        if r["is_first"]:
            while name and name in taken:
                name, n = f"{r['id']}__dup{n}", n + 1
            out.append({"pos": r["pos"], "id": name})
        taken.add(name)
    return out


def with_cover(resources: DataFrame, covers: DataFrame) -> DataFrame:
    """resources(book_id, pos, id, href) and covers(book_id, id, href) -> (book_id, pos, id, is_new) of each book's cover.

    A cover whose href a resource has is that resource; any other comes after the book's last one, its id made unique.
    """
    last = resources.groupBy("book_id").agg(F.max("pos").alias("last"))
    added = covers.join(last, "book_id", "left").select("book_id", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("pos"), "id", "href")
    every = canonical_ids(resources.select("book_id", F.col("pos").cast("long").alias("pos"), "id", "href").unionByName(added))
    keyed = covers.select("book_id", clean_href(F.col("href")).alias("href_key"))
    return every.join(keyed, ["book_id", "href_key"]).join(last, "book_id", "left").select("book_id", "pos", "id", (F.col("pos") > F.coalesce("last", F.lit(-1))).alias("is_new"))


def canonical_order(reading_order: DataFrame, resources: DataFrame) -> DataFrame:
    """The reading order with each dropped resource replaced by the one that stands for it."""
    stand_in = deduped(resources).select("book_id", F.col("pos").alias("resource_pos"), "first_pos")
    return reading_order.join(stand_in, ["book_id", "resource_pos"], "left").select(
        "book_id", "pos", F.coalesce("first_pos", "resource_pos").alias("resource_pos"), "linear"
    )


def by_id(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lookup of wanted(book_id, id)."""
    return wanted.join(resources, ["book_id", "id"])


def by_href(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lookup of wanted(book_id, href) by clean href."""
    keyed = wanted.select("book_id", clean_href(F.col("href")).alias("href_key"))
    return keyed.join(unique_resources(resources), ["book_id", "href_key"])


def cover(items: DataFrame, metas: DataFrame) -> DataFrame:
    """(book_id, id): the first item with the property cover-image, else the id that a meta named cover gives."""
    marked = items.where(F.coalesce(F.col("properties"), F.lit("")).contains("cover-image")).groupBy("book_id").agg(F.min_by("id", "pos").alias("marked"))
    named = metas.where("name = 'cover' AND content <> ''").groupBy("book_id").agg(F.min_by("content", "pos").alias("named"))
    both = marked.join(named, "book_id", "full")
    return both.select("book_id", F.coalesce("marked", "named").alias("id"))


def charset_column(media_type: Column, charset: Column) -> Column:
    """A resource's charset: as given, else utf-8 for text and binary for the rest."""
    given = F.lower(F.trim(F.coalesce(charset, F.lit(""))))
    return F.when(given != "", given).when(is_text(media_type), "utf-8").otherwise("binary")


def reading_text(parts: DataFrame, separator: str = "") -> DataFrame:
    """parts(book_id, pos, linear, text) -> (book_id, text): linear parts in order, `separator` between them.

    A book without linear parts has an empty text. One shuffle by book; a book's text is one row.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("linear"), F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))))
    rows = parts.groupBy("book_id").agg(ordered.alias("parts"))
    return rows.select("book_id", F.array_join(F.transform("parts", lambda p: p["text"]), separator).alias("text"))


def counts(resources: DataFrame, reading_order: DataFrame) -> DataFrame:
    """(book_id, n_resources, n_linear, n_other)."""
    n = resources.groupBy("book_id").agg(F.count("*").alias("n_resources"))
    order = reading_order.groupBy("book_id").agg(F.count_if("linear").alias("n_linear"), F.count_if(~F.col("linear")).alias("n_other"))
    return n.join(order, "book_id", "left").na.fill(0)
