"""Arrow-batched row functions: the one bridge from tables to binary codecs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Each row of df (a dict) becomes the rows that fn gives for it. Batches are cut by Arrow's own limits."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = [out for row in b.slice(lo, 256).to_pylist() for out in fn(row)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    return df.mapInArrow(run, schema)


def binary_function(fn: Callable, returns: str) -> Callable[[Column | str], Column]:
    """A column function of one argument over Arrow batches; null gives null."""
    import pandas as pd

    def over(column: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in column], dtype=object)

    over.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return lambda col: F.pandas_udf(over, returns)(col)


def map_groups(df: DataFrame, by: list[str], fn: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """The rows of each group (a document's or a page's, of bounded size) become the rows that fn gives for them."""
    rest = [c for c in df.columns if c not in by]

    def each(row: dict) -> Iterable[dict]:
        key = {c: row[c] for c in by}
        return fn([key | r for r in row["_rows"]])

    return map_rows(df.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("_rows")), each, schema)


def spread(df: DataFrame, key: str, times: int = 4) -> DataFrame:
    """df dealt to all cores by a key, `times` partitions each (or as many as shuffles have): for work that is heavy for its bytes, where a table may be one split."""
    spark = df.sparkSession
    return df.repartition(max(times * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
