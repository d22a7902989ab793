"""Annotations: s-expressions as rows, and back to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquarry.formats import payloads
from leafquarry.functions import arrow, jvm

ANNOTATION = "ann_id int, parent_id int, ord int, depth int, name string, value string"


def texts(chunk_rows: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of annotation chunks, plain or compressed."""
    raw = chunk_rows.filter("chunk_type in ('ANTA', 'ANTZ')")
    body = F.when(F.col("chunk_type") == "ANTZ", jvm.call(raw, "BzzDecode", "binary", F.col("payload"))).otherwise(F.col("payload"))
    return raw.select("doc_id", "node_id", F.decode(body, "UTF-8").alias("text"))


def parse(text_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Expressions and parameters of texts in pre-order; a text that is not closed has a row with `error` besides."""

    def rows(row: dict):
        got, error = payloads.read_annotations(row["text"] or "")
        for r in got:
            yield {"key": row["key"], "error": None, **r}
        if error:
            yield {"key": row["key"], "error": error}

    return arrow.map_rows(text_rows.select(F.col(key).alias("key"), "text"), rows, f"key long, {ANNOTATION}, error string").withColumnRenamed("key", key)


def trees(text_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, name, tree): top-level expressions, the whole tree as VARIANT."""
    import json

    def rows(row: dict):
        found, _ = payloads.split_annotations(row["text"] or "")
        for k, x in enumerate(found):
            tree = payloads.parse_annotation(x)
            yield {"key": row["key"], "ord": k, "name": tree["name"], "json": json.dumps(tree)}

    return arrow.map_rows(text_rows.select(F.col(key).alias("key"), "text"), rows, "key long, ord int, name string, json string").select(F.col("key").alias(key), "ord", "name", F.parse_json("json").alias("tree"))


def render(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the expressions of each text put back from their rows."""

    def build(nodes: list[dict]):
        kids: dict = {}
        for n in sorted(nodes, key=lambda n: n["ord"]):
            kids.setdefault(n["parent_id"], []).append(n)

        def tree(n: dict):
            return n["value"] if n["value"] is not None else {"name": n["name"] or "", "params": [tree(c) for c in kids.get(n["ann_id"], [])]}

        tops = [tree(n) for n in kids.get(None, [])]
        yield {key: nodes[0][key], "text": " ".join(t if isinstance(t, str) else payloads.render_annotation(t) for t in tops)}

    return arrow.map_groups(rows.filter("ann_id is not null").select(key, "ann_id", "parent_id", "ord", "name", "value"), [key], build, f"{key} long, text string")
