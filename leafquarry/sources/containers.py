"""Container files as tables. The scan never decodes a payload; operators decode the columns that they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.functions import binary, jvm

CHUNKS = "doc_id long, node_id int, parent_id int, ord int, depth int, subtree_end int, form_type string, chunk_id string, chunk_type string, node_offset long, data_offset long, length long, payload binary, page_no int, error string"


def scan(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Files below a path of any Hadoop file system: doc_id, path, name, length, modification_time, is_container, content.

    Column pruning reaches the files: without `content` and `is_container` nothing is opened.
    """
    reader = spark.readStream if stream else spark.read
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = reader.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.xxhash64("path").alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length",
        F.col("modificationTime").alias("modification_time"), binary.is_container(F.col("content")).alias("is_container"), "content",
    )


def walk(files: DataFrame) -> DataFrame:
    """Chunk rows of (doc_id, content) rows, leaves with their payload. Bytes that cannot be read give one row with `error`.

    page_no is that of a page form and of its direct children, from 1 in file order: a file is walked as a whole, so nothing is shuffled for it.
    """
    columns = ", ".join("{}: {}".format(*c.split(" ")) for c in CHUNKS.split(", ")[1:])
    return files.select("doc_id", F.inline(jvm.call(files, "WalkFile", f"array<struct<{columns}>>", F.col("content"))))


def chunks(files: DataFrame) -> DataFrame:
    return walk(files).filter("error is null").drop("error")


def parse_errors(files: DataFrame) -> DataFrame:
    return walk(files).filter("error is not null").select("doc_id", "error")


def dump(chunk_rows: DataFrame) -> DataFrame:
    """One JSON text for each document: its nodes in file order, with place, size and type."""
    node = F.struct(F.col("node_id"), F.col("parent_id"), F.col("chunk_id").alias("ID"), F.col("form_type").alias("Type"), F.col("node_offset").alias("Offset"), F.col("length").alias("Size"))
    return chunk_rows.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(node))).alias("json"))
