"""Substring dedup: word windows that an earlier document has are removed.

Level-wise doubling. The first level looks at windows of half the width: of these, a document offers only
its minimizers (in each run of starts that one full window spans, the window of least hash), as equal full
windows offer the same ones. Windows found in one document alone go; around the repeated ones, and
nowhere else, windows of twice that length are built and counted: the second level. There the removal
is settled, as a longer repeat is covered by windows of the full width. `lengths` goes on doubling: what repeats at one
length alone is extended to twice that length, until no candidates survive, which tells how long each document's longest repeat is.

Half windows are told apart by 64 bits, which decides only what is looked at next; windows of the full width and longer by
two such hashes (128 bits). A document gives each hash once, however often its window recurs in it.
Exact copies (the same words) leave after the first level: all but those of the smallest id are repeated
as a whole. A window's first document is a minimum, summed before it is dealt out; the rows of a
very common window go back to their documents by a plain join, which adaptive execution splits.

Defined results: a null text has no words; a null doc_id comes after all others; rows of the same doc_id do
not repeat each other; a document of fewer words than a window keeps all; an empty table gives no row;
extra columns are ignored by `report` and kept by `remove`, whatever their names. Rows get their numbers in one
job that writes them, so that reading the input again in another order changes nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import common

WIDTH = 50



def _least(w: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of `span` values, by doubling."""
    n, least, size = len(w) - span + 1, w, 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    return np.minimum(least[:n], least[span - size : span - size + n])


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the half-width windows that are least within a full window."""
    w = common.window_hashes(h, width // 2)
    span = width - width // 2 + 1  # starts of half windows in a full one
    return np.unique(_least(w, span)) if len(w) >= span else np.empty(0, np.uint64)


def full_windows(h: np.ndarray, half: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct double hashes of full windows whose least half window has one of the hashes `half`."""
    w = common.window_hashes(h, width // 2)
    return _distinct(h, width, np.isin(_least(w, width - width // 2 + 1), half))


def _distinct(h: np.ndarray, width: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = common.window_hashes(h, width)[which], common.window_hashes(h, width, seed=1)[which]
    _, at = np.unique(one, return_index=True)
    return one[at], two[at]


def _marked(h: np.ndarray, width: int, pairs: list) -> np.ndarray:
    """Which windows have one of the double hashes `pairs`."""
    one, two = (common.window_hashes(h, width, seed=k) for k in (0, 1))
    known = np.array([tuple(p.values()) for p in pairs], np.int64).view(np.uint64).reshape(-1, 2)
    known = known[np.argsort(known[:, 0])]
    at = np.minimum(np.searchsorted(known[:, 0], one), len(known) - 1)
    return (known[at, 0] == one) & (known[at, 1] == two)


def _offers(keyed: DataFrame, width: int) -> DataFrame:
    """For each document its words' count and digests, and what it offers to the first level."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("uid", "key", "n_words", "same", "sha", "hash")}
            for uid, key, text in zip(b["uid"], b["key"], b["text"], strict=True):
                words = common.spaced_words(text)
                joined = b" ".join(words)
                hashes = minimizers(common.word_hashes(words), width) if len(words) >= width else np.empty(0, np.uint64)
                for c, v in zip(out, (uid, key, len(words), hashlib.md5(joined).digest(), hashlib.sha256(joined).hexdigest(), common.signed(hashes).tolist()), strict=True):
                    out[c].append(v)
            yield out

    return common.map_columns(keyed.select("uid", "key", common.bytes_of("text").alias("text")), run, "uid long, key long, n_words long, same binary, sha string, hash array<long>")


def _repeated(rows: DataFrame, by: list[str], other: str) -> DataFrame:
    """Hashes (columns `by`) of `rows` that more than one `other` has, with the smallest key.

    A table of its own, so that the join back has two plain sides and adaptive execution can split a common hash.
    """
    ends = rows.groupBy(*by).agg(F.min("key").alias("first"), F.min(other).alias("lo"), F.max(other).alias("hi"))
    return common.cut(ends.filter("lo < hi").select(*by, "first"))


_WIDE = "uid long, key long, hash array<struct<one:long,two:long>>"


def _wide(uids: list, keys: list, got: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    return {"uid": uids, "key": keys, "hash": [[{"one": x, "two": y} for x, y in zip(common.signed(a).tolist(), common.signed(b).tolist(), strict=True)] for a, b in got]}


def _repeats(wide: DataFrame) -> DataFrame:
    """(uid, key, one, two, first): the windows of `wide` that documents of several keys have, with the smallest key; a table."""
    rows = wide.select("uid", "key", F.explode("hash").alias("x")).select("uid", "key", "x.one", "x.two")
    full = _repeated(rows, ["one", "two"], "key")
    out = common.cut(rows.join(full, ["one", "two"]))
    common.discard(full)
    return out


def covered(keyed: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all, texts, repeats, twins) for keyed documents.

    all: uid, key, n_words, sha for every document. texts: uid, key, text of those that may repeat another one in part, repeats: their
    repeated windows. twins: uid of copies of an earlier document, all of whose windows are repeats.
    """
    offers = common.cut(_offers(keyed, width))
    every = offers.select("uid", "key", "n_words", "sha")
    classes = offers.filter(F.col("n_words") >= width).select("uid", "key", "same")
    firsts = common.cut(classes.groupBy("same").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").select("same", "first"))
    twins = common.cut(classes.join(firsts, "same").filter("key > first").select("uid"))
    spots = offers.select("uid", "key", F.expr("xxhash64(same)").alias("same"), F.explode("hash").alias("hash"))
    half = _repeated(spots.select("hash", "key", "same"), ["hash"], "same")
    near = common.among(spots.select("uid", "hash"), half, "hash").groupBy("uid").agg(F.collect_list("hash").alias("half"))
    near = common.cut(near.join(twins, "uid", "left_anti"))
    texts = common.cut(common.narrowed(keyed.select("uid", "key", common.bytes_of("text").alias("text")), near, "uid").join(near, "uid"))
    common.discard(near)

    def run(batches):
        for b in batches:
            yield _wide(b["uid"], b["key"], [full_windows(common.word_hashes(common.spaced_words(t)), np.array(a, np.int64).view(np.uint64), width) for t, a in zip(b["text"], b["half"], strict=True)])

    wide = common.cut(common.map_columns(texts.select("uid", "key", "text", "half"), run, _WIDE))
    repeats = _repeats(wide)
    common.discard(wide, half)
    return every, texts.select("uid", "key", "text"), repeats, twins


def _pairs(repeats: DataFrame, name: str) -> DataFrame:
    return repeats.groupBy("uid").agg(F.collect_list(F.struct("one", "two")).alias(name))


def _marks(repeats: DataFrame) -> DataFrame:
    """(uid, marks): the windows to remove."""
    return _pairs(repeats.filter("key > first"), "marks")


def _left(words: list[bytes], marks: list, width: int) -> list[bytes]:
    """The words that no window with a double hash of `marks` covers."""
    starts = np.flatnonzero(_marked(common.word_hashes(words), width, marks))
    gone = np.zeros(len(words) + 1, np.int64)
    gone[starts] += 1
    gone[starts + width] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def lengths(texts: DataFrame, repeats: DataFrame, width: int = WIDTH) -> DataFrame:
    """(uid, longest): the greatest length of width * 2^k words that a window of a text has which an earlier document has, too.

    Each level reads only texts with a repeat at the level before, and extends only windows both of whose halves were repeats.
    """
    out, size = repeats.filter("key > first").select("uid").distinct().withColumn("longest", F.lit(width)), width
    while True:
        size *= 2

        def run(batches, size=size):
            for b in batches:
                got = []
                for t, known in zip(b["text"], b["known"], strict=True):
                    h = common.word_hashes(common.spaced_words(t))
                    ok = _marked(h, size // 2, known)
                    got.append(_distinct(h, size, ok[: -(size // 2)] & ok[size // 2 :]) if len(h) >= size else (np.empty(0, np.uint64),) * 2)
                yield _wide(b["uid"], b["key"], got)

        wide = common.cut(common.map_columns(texts.join(common.cut(_pairs(repeats, "known")), "uid").select("uid", "key", "text", "known"), run, _WIDE).filter("size(hash) > 0"))
        repeats = _repeats(wide)
        common.discard(wide)
        if repeats.isEmpty():
            break
        out = out.unionByName(repeats.filter("key > first").select("uid").distinct().withColumn("longest", F.lit(size)))
    return common.cut(out.groupBy("uid").agg(F.max("longest").alias("longest")))


def _kept_words(marked: DataFrame, width: int) -> DataFrame:
    """uid, n_removed, kept (the words left, joined by a space)."""

    def run(batches):
        for b in batches:
            out = {"uid": b["uid"], "n_removed": [], "kept": [], "kept_sha256": []}
            for text, marks in zip(b["text"], b["marks"], strict=True):
                words = common.spaced_words(text)
                left = _left(words, marks, width)
                kept = b" ".join(left)
                out["n_removed"].append(len(words) - len(left))
                out["kept"].append(kept.decode())
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield out

    return common.map_columns(marked, run, "uid long, n_removed long, kept string, kept_sha256 string")


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, longest (0: no window of the width is in an earlier document)."""
    every, texts, repeats, twins = covered(common.keyed(common.pick(docs, "doc_id", "text")), width)
    changed = common.cut(_kept_words(texts.join(_marks(repeats), "uid").select("uid", "text", "marks"), width).select("uid", "n_removed", "kept_sha256"))
    nothing = hashlib.sha256(b"").hexdigest()
    out = every.join(changed, "uid", "left").join(lengths(texts, repeats, width), "uid", "left").join(twins.withColumn("twin", F.lit(True)), "uid", "left")
    whole = F.lit(width) * F.pow(F.lit(2), F.floor(F.log2(F.col("n_words") / width)))
    return out.select(
        F.when(F.col("key") != common.NULL_ID, F.col("key")).alias("doc_id"), "n_words",
        F.when(F.col("twin"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("twin"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("twin"), whole).otherwise(F.coalesce("longest", F.lit(0))).cast("long").alias("longest"),
    )


def remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the words of `text` that are left, joined by a space, where some were removed; documents of which nothing is left go."""
    keyed = common.keyed(docs)
    _, texts, repeats, twins = covered(keyed, width)
    changed = common.cut(_kept_words(texts.join(_marks(repeats), "uid").select("uid", "text", "marks"), width).select("uid", "kept"))
    same = common.without(keyed, common.cut(changed.select("uid").unionByName(twins)), "uid")
    less = common.narrowed(keyed.drop("text"), changed, "uid").join(changed.filter("kept != ''").withColumnRenamed("kept", "text"), "uid")
    return common.unkeyed(same.unionByName(less), docs)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
seen AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS lo FROM win) WHERE doc_id > lo OR doc_id IS NULL AND lo IS NOT NULL),
big AS (SELECT d.rid, d.doc_id, m, md5(array_to_string(list_slice(w, i, i + m - 1), ' ')) AS g
  FROM (SELECT rid, doc_id, w FROM d WHERE rid IN (SELECT rid FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g))) d,
    (SELECT unnest([50, 100, 200, 400, 800, 1600, 3200, 6400, 12800]) AS m), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
far AS (SELECT rid, max(m) AS longest FROM (SELECT rid, m, doc_id, min(doc_id) OVER (PARTITION BY m, g) AS lo FROM big) WHERE doc_id > lo OR doc_id IS NULL AND lo IS NOT NULL GROUP BY rid),
gone AS (SELECT rid, list(DISTINCT p) AS p FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM seen) GROUP BY rid),
left_ AS (SELECT d.rid, len(p) AS n, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN m[k] IS NULL THEN w[k] END), lambda x: x IS NOT NULL), ' ') AS kept
  FROM (SELECT gone.rid, gone.p, map_from_entries(list_transform(gone.p, lambda q: struct_pack(k := q, v := 1))) AS m FROM gone) g JOIN d ON d.rid = g.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN left_ USING (rid) LEFT JOIN far USING (rid)
"""
