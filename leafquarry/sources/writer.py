"""Rows back into container files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafquarry.formats import iff
from leafquarry.functions import arrow


def assemble(chunk_rows: DataFrame) -> DataFrame:
    """(doc_id, content): the bytes of each document from its chunk rows, lengths and alignment computed anew."""

    def build(nodes: list[dict]):
        kids: dict = {}
        for r in sorted(nodes, key=lambda r: (r["parent_id"] is not None, r["parent_id"], r["ord"], r["node_id"])):
            kids.setdefault(r["parent_id"], []).append(r)

        def put(r: dict) -> bytes:
            if r["form_type"] is None:
                return iff.chunk(r["chunk_id"], r["payload"] or b"")
            return iff.form(r["form_type"], [put(c) for c in kids.get(r["node_id"], [])])

        roots = kids.get(None, [])
        yield {"doc_id": nodes[0]["doc_id"], "content": iff.container(put(roots[0])) if roots else None}

    return arrow.map_groups(chunk_rows.select("doc_id", "node_id", "parent_id", "ord", "form_type", "chunk_id", "payload"), ["doc_id"], build, "doc_id long, content binary")
