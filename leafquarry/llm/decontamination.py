"""Benchmark decontamination: Wu-Manber search of documents for windows of benchmark items.

The alphabet is words. Patterns of one length share tables over blocks of two words: the shift table
tells how far the end of the window may move, a zero shift leads to the bucket of that suffix block,
and a pattern of the bucket counts only after direct comparison of all words.

Defined results: a null or empty text has no words and no hits; an item without words is none; an item of
fewer words than a window is one window; items of the same text all count; an item without an id counts
as a hit under the id ""; repeated document rows are reported each; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import common

WINDOW = 10
#: Benchmark text that one pass holds in its tables; a larger benchmark is searched in several passes.
PATTERN_BYTES = 2 << 20


class Searcher:
    """Wu-Manber tables for patterns of any lengths; each length has tables of its own."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        of: dict[tuple, set[str]] = defaultdict(set)
        for name, words in items:
            for i in range(max(1, len(words) - window + 1) if words else 0):
                of[tuple(words[i : i + window])].add(name)
        self.items = dict(of)
        self.single = {p[0] for p in of if len(p) == 1}
        self.groups = []
        for m in sorted({len(p) for p in of} - {1}):
            far, shift, buckets = m - 1, {}, defaultdict(set)
            for p in of:
                if len(p) == m:
                    for j in range(2, m + 1):
                        block = p[j - 2 : j]
                        shift[block] = min(shift.get(block, far), m - j)
                    buckets[p[m - 2 :]].add(p)
            self.groups.append((m, far, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """Which words lie in an occurrence (None: none), and the names of the items with one."""
        n, hit, found = len(words), None, set()
        for m, far, shift, buckets in self.groups:
            get, i = shift.get, m - 1
            while i < n:
                block = (words[i - 1], words[i])
                if step := get(block, far):
                    i += step
                    continue
                here = tuple(words[i - m + 1 : i + 1])
                if here in buckets[block]:
                    hit = hit or bytearray(n)
                    hit[i - m + 1 : i + 1] = b"\1" * m
                    found |= self.items[here]
                i += 1
        if self.single:
            for i, w in enumerate(words):
                if w in self.single:
                    hit = hit or bytearray(n)
                    hit[i] = 1
                    found |= self.items[(w,)]
        return hit, found


def searchers(benchmark: DataFrame, window: int = WINDOW, most: int = PATTERN_BYTES):
    """(number of passes, the searchers of the passes one after the other): together they hold all items, each over `most` bytes of text or so."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(common.bytes_of("text"), F.lit(b"")).alias("body"))
    size = b.agg(F.sum(F.length("body"))).first()[0] or 0
    passes = max(1, -(-size // most))

    def each():
        for k in range(passes):
            part = b if passes == 1 else b.filter(F.pmod(F.xxhash64("name", "body"), F.lit(passes)) == k)
            yield Searcher([(r.name, common.plain_words(bytes(r.body))) for r in part.toLocalIterator()], window)

    return passes, each()


def _search(held, text: bytes | None) -> tuple[bytes | None, list[str]]:
    got, found = held.value.search(common.plain_words(text))
    return bytes(got) if got else None, sorted(found)


def mark(docs: DataFrame, benchmark: DataFrame, hit: str = "_hit", items: str = "_items", window: int = WINDOW, most: int = PATTERN_BYTES) -> DataFrame:
    """docs with the places of hit words (binary, a byte a word; null: no hit) and the item ids found (array<string>).

    A benchmark that needs several passes is searched by one after the other: each writes what it found and lets its tables go
    before the next are made, so that driver and executors hold those of one pass.
    """
    spark = docs.sparkSession
    passes, each = searchers(benchmark, window, most)
    if passes == 1:
        held = spark.sparkContext.broadcast(next(each))

        def run(batches):
            for b in batches:
                got = [_search(held, t) for t in b["text"]]
                yield {hit: [g[0] for g in got], items: [g[1] for g in got]}

        return common.append_columns(docs, ["text"], run, f"`{hit}` binary, `{items}` array<string>")

    uid = common.fresh(docs, "lq_uid")
    numbered, found = common.numbered(docs, uid), None
    for searcher in each:
        held = spark.sparkContext.broadcast(searcher)

        def run(batches, held=held):
            for b in batches:
                got = [(u, *_search(held, t)) for u, t in zip(b["uid"], b["text"], strict=True)]
                got = [g for g in got if g[1]]
                yield {"uid": [g[0] for g in got], "hit": [g[1] for g in got], "items": [g[2] for g in got]}

        one = common.cut(common.map_columns(numbered.select(F.col(f"`{uid}`").alias("uid"), common.bytes_of("text").alias("text")), run, "uid long, hit binary, items array<string>"))
        held.destroy()
        del held, run, searcher
        found = one if found is None else found.unionByName(one)

    def merge(batches):
        for b in batches:
            yield {"uid": b["uid"], "hit": [np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in hs]).tobytes() for hs in b["hits"]], "items": [sorted({x for part in parts for x in part}) for parts in b["parts"]]}

    merged = found.groupBy("uid").agg(F.collect_list("hit").alias("hits"), F.collect_list("items").alias("parts"))  # a row for each pass at most
    merged = common.cut(common.map_columns(merged, merge, "uid long, hit binary, items array<string>"))
    out = numbered.join(merged.select(F.col("uid").alias(uid), F.col("hit").alias(hit), F.col("items").alias(items)), uid, "left")
    return out.withColumn(items, F.coalesce(F.col(items), F.array().cast("array<string>"))).select(*[F.col(f"`{c}`") for c in docs.columns], hit, items)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = PATTERN_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated."""
    marked = mark(common.pick(docs, "doc_id", "text"), benchmark, "hit", "items", window, most)

    def run(batches):
        for b in batches:
            names = [sorted(x) for x in b["items"]]
            yield {
                "n_words": [len(common.plain_words(t)) for t in b["text"]],
                "n_hit": [sum(h) if h else 0 for h in b["hit"]],
                "n_items": [len(x) for x in names],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
            }

    out = common.append_columns(marked, ["text", "hit", "items"], run, "n_words long, n_hit long, n_items long, items_sha256 string")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = PATTERN_BYTES) -> DataFrame:
    """The documents without a hit, with the columns of docs."""
    return mark(docs, benchmark, hit := common.fresh(docs, "lq_hit"), items := common.fresh(docs, "lq_items"), window, most).filter(F.col(hit).isNull()).drop(hit, items)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
spot AS (SELECT rid, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM d, (SELECT DISTINCT m FROM win), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
hit AS (SELECT rid, i, spot.m, item_id FROM spot JOIN win ON spot.m = win.m AND spot.g = win.g),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
