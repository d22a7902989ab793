"""Container files as a stream: new files become chunk rows and text hits as they arrive. Stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafquarry.sources import containers


def chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of the files that arrive below a path."""
    return containers.walk(containers.scan(spark, path, stream=True).select("doc_id", "content"))


def write_chunks(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the chunk rows of new files to a table; with `once` stop when all files that are there are done."""
    writer = chunk_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
