"""Bookmarks and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquarry.functions import jvm

BOOKMARK = "bm_id int, parent_id int, ord int, depth int, subtree_end int, name string, url string"


def bookmarks(chunk_rows: DataFrame) -> DataFrame:
    """Bookmarks of documents in pre-order, with the number of bookmarks below each."""

    fields = ", ".join("{}: {}".format(*f.split(" ")) for f in BOOKMARK.split(", "))
    out = chunk_rows.filter("chunk_type = 'NAVM'").select("doc_id", F.inline(jvm.call(chunk_rows, "Bookmarks", f"array<struct<{fields}>>", F.col("payload"))))
    return out.withColumn("n_below", F.col("subtree_end") - F.col("bm_id"))


def target_pages(marks: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Bookmarks with the page that their url ("7" or "#7") names; null where it names no page of the document."""
    number = F.expr("try_cast(regexp_extract(url, '^#?([0-9]+)$', 1) as int)")
    there = page_rows.select("doc_id", F.col("page_no").alias("_page"))
    m = marks.withColumn("_page", number)
    return m.join(there.withColumn("page_no", F.col("_page")), ["doc_id", "_page"], "left").drop("_page")


def bad_targets(targets: DataFrame) -> DataFrame:
    """Bookmarks that lead nowhere, as error rows."""
    return targets.filter("page_no is null").select("doc_id", "bm_id", F.concat(F.lit("no page for "), F.coalesce("url", F.lit("null"))).alias("error"))


def outline(page_rows: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, ord, name, url): top bookmarks, or one entry for each page of a document without any."""
    own = marks.filter("parent_id is null").select("doc_id", "ord", "name", "url")
    made = page_rows.join(marks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", (F.col("page_no") - 1).alias("ord"), F.concat(F.lit("Page "), F.col("page_no").cast("string")).alias("name"), F.concat(F.lit("#"), F.col("page_no").cast("string")).alias("url"))
    return own.unionByName(made)
