"""The codecs as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """bzz_encode, bzz_decode (binary), annotation_names (text to array): Arrow batches, one call a value."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from leafquarry.codec import bzz
    from leafquarry.formats import payloads

    def over(fn):
        def call(column: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else fn(v) for v in column], dtype=object)

        call.__annotations__ = {"column": pd.Series, "return": pd.Series}
        return call

    spark.udf.register("bzz_encode", pandas_udf(over(lambda v: bzz.encode(bytes(v))), "binary"))
    spark.udf.register("bzz_decode", pandas_udf(over(lambda v: bzz.decode(bytes(v))), "binary"))
    spark.udf.register("annotation_names", pandas_udf(over(lambda v: [payloads.parse_annotation(x)["name"] for x in payloads.split_annotations(v)[0]]), "array<string>"))
