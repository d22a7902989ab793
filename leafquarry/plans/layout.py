"""A word layout of the documents table, as zones in tables and as container files.

Words are split at spaces, tabs and line ends; eight make a line, forty lines a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.formats import build
from leafquarry.functions import arrow, jvm

PAGE_HEIGHT = build.PAGE_LINES * build.LEADING
_PER_PAGE = build.LINE_WORDS * build.PAGE_LINES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(documents: DataFrame) -> DataFrame:
    """One zone row for each word of each document."""
    split = F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")
    i = F.col("i")
    return documents.select("doc_id", F.posexplode(split).alias("i", "text")).select(
        "doc_id", (F.floor(i / _PER_PAGE) + 1).cast("int").alias("page_no"), i.alias("zone_id"), F.floor(i / build.LINE_WORDS).cast("int").alias("parent_id"), (i % build.LINE_WORDS).alias("ord"),
        F.lit("Word").alias("zone_type"), (i % build.LINE_WORDS * build.PITCH).alias("x"), (F.floor(i / build.LINE_WORDS) % build.PAGE_LINES * build.LEADING).cast("int").alias("y"),
        (8 * F.length("text")).alias("width"), F.lit(16).alias("height"), F.lit(0).alias("n_children"), "text",
    )


def blocks(documents: DataFrame, size: int, name: str) -> DataFrame:
    """(doc_id, `name`, words): each document's words in blocks of `size`, numbered from 0. The words stay in their document's row until here: no shuffle."""
    split = F.array_remove(F.split("text", "[ \t\n\r]+"), "")
    made = documents.select("doc_id", split.alias("ws")).filter("size(ws) > 0")
    k = F.explode(F.expr(f"transform(sequence(0, (size(ws) - 1) div {size}), k -> struct(cast(k as int) as {name}, slice(ws, cast(k as int) * {size} + 1, {size}) as words))"))
    return made.select("doc_id", k.alias("b")).select("doc_id", "b.*")


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, line, words) of each line."""
    b = blocks(arrow.spread(documents.select("doc_id", "text"), "doc_id"), build.LINE_WORDS, "line")
    return b.select("doc_id", (F.floor(F.col("line") / build.PAGE_LINES) + 1).cast("int").alias("page_no"), "line", "words")


def page_words(documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, words) of each page."""
    b = blocks(arrow.spread(documents.select("doc_id", "text"), "doc_id"), _PER_PAGE, "page")
    return b.select("doc_id", (F.col("page") + 1).cast("int").alias("page_no"), "words")


def pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page_no) of every page with a word, without spreading the words."""
    n = F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != ""))
    return documents.select("doc_id", n.alias("n")).filter("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / _PER_PAGE).cast("int"))).alias("page_no"))


def containers(documents: DataFrame, layer: str = "TXTa") -> DataFrame:
    """(doc_id, content): each document as a bundled container file. Every third id has no outline."""

    docs = arrow.spread(documents.select("doc_id", "text", "lang", "source"), "doc_id")
    known = lambda c: F.coalesce(c, F.lit("None"))
    notes = F.concat(F.lit('(metadata (lang "'), known("lang"), F.lit('") (source '), known("source"), F.lit("))"))
    outline = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    return docs.select("doc_id", jvm.call(docs, "MakeFile", "binary", F.col("text").cast("binary"), notes, outline, F.lit(layer == "TXTz")).alias("content"))


#: The words for DuckDB, as w(doc_id, i, word).
WORDS_SQL = r"""w AS (SELECT doc_id, CAST(i AS INTEGER) AS i, word FROM (
  SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)))"""
ZONES_SQL = (
    WORDS_SQL
    + """, z AS (SELECT doc_id, i // 320 + 1 AS page_no, i AS zone_id, i // 8 AS parent_id, i % 8 AS ord, (i % 8) * 100 AS x,
  ((i // 8) % 40) * 20 AS y, 8 * length(word) AS width, 16 AS height, word AS text FROM w),
p AS (SELECT DISTINCT doc_id, page_no FROM z)"""
)
