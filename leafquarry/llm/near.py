"""MinHash near-dedup by a containment ensemble over five-word shingles.

Two texts are near copies if their common shingles are at least `least` (0.8) of the larger one's set; so
each contains the other to that share, and every pair of Jaccard similarity 0.8 is among them. Texts
are partitioned by the size of their shingle set (powers of two). For each partition the containment
threshold becomes the least Jaccard similarity that such a pair can have there, and the banding is
tuned to it; a text offers its bands to its own partition, and to the next one where a partner may be.

Candidates are links, never all pairs of a bucket. First, texts of equal sets are one class. Each bucket then
compares its members with one centre by their exact sets, and the links found make components. For texts of
buckets that still hold several components, an exact prefix filter over their shingles (rarest first) gives the pairs
of different components that can be linked, and these are compared too; a pair within a component
needs no comparison. Components come by large-star and small-star steps over tables; nothing is collected.

Groups are linked by their representatives (smallest doc_id, then text): one is held by a larger one of another group if their common shingles are at least `least` of the smaller set. For
these directed links the size partitions alone decide nothing: a text of 20 shingles in one of 20,000 has Jaccard similarity 0.001, which no
banding finds. They come from bottom sketches: the SAMPLE least hashes of a set, which a holder has to hold at the rate of
the whole set. Every text looks all its shingles up among the samples (a bit table of at most FILTER_BITS thins out what is
shuffled, never the result, and has the more room for a range of hashes the more are looked up there); a text is held only if enough of its sample stands in other groups, and then its
rarest such shingles lead to candidates, which are compared exactly. Sets of SAMPLE shingles at most are their own sample, and lose nothing;
a larger set that is held by exactly `least` is missed with a chance of 0.001.

Defined results: words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased (if a text has none: of
anything but white space); fewer than five words are one shingle; a text without words (or null) is
alone; a null doc_id comes last; class_id is the smallest doc_id of the group (null if it has none); an empty table
gives no row; held_by is the smallest class_id of the groups whose representative holds that of a row's group (null: none), n_holders
how many do. Rows get their numbers in one job that writes them, so that reading the input again in another order changes nothing.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import common

WORDS, LEAST, HASHES = 5, 0.8, 128
#: A pair at the threshold itself may miss all bands with this chance at most, where HASHES allows it.
MISS = 1e-3
#: Shingles in the sets that a task keeps while it compares pairs.
HELD = 4_000_000
#: Least hashes that stand for a set when larger texts are searched for it, and how many of them a holder must have.
SAMPLE, SAMPLE_NEED = 24, 13
#: The most bits of the table of sampled hashes (64 MB), whatever the input. With many more hashes than bits nearly all others pass
#: and are shuffled, to the same result.
FILTER_BITS = 1 << 29
#: Ranges of hashes in that table: the upper half, the upper half of the rest, and so on.
RANGES = 16


def shingles(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = common.plain_words(text) or common.spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = common.word_hashes(words)
    return np.unique(common.window_hashes(h, min(width, len(h)), seed=min(width, len(h))))


def partition(n: int) -> int:
    """Partition k holds the sets of 2^k to 2^(k+1) - 1 shingles."""
    return n.bit_length() - 1


def least_jaccard(k: int, least: float = LEAST) -> float:
    """The least Jaccard similarity of a linked pair whose larger set is in partition k."""
    worst = 1.0
    for x in {2**k, 2 ** (k + 1) - 1, *range(2**k, min(2 ** (k + 1), 2**k + 64))}:
        common_ = math.ceil(least * x - 1e-9)
        worst = min(worst, common_ / (x + x - common_))  # the smaller set is largest when it is as large
    return worst


@lru_cache(maxsize=64)
def banding(k: int, least: float = LEAST, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) for partition k: the most rows whose chance to miss a pair at the threshold is within MISS, else the surest."""
    s = least_jaccard(k, least)
    for rows in range(16, 0, -1):
        bands = 1 if s >= 1 else math.ceil(math.log(MISS) / math.log1p(-(s**rows)))
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


@lru_cache(maxsize=1)
def _seeds(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(9)
    return r.integers(1, 2**63, hashes, np.uint64) | np.uint64(1), r.integers(0, 2**63, hashes, np.uint64)


def minhash(h: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Least values of `hashes` random functions over a set of mixed hashes, in slices of bounded size."""
    a, b = _seeds(hashes)
    out = np.full(hashes, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), 4096):
            out = np.minimum(out, (h[None, lo : lo + 4096] * a[:, None] + b[:, None] >> np.uint64(20)).min(axis=1))
    return out


def bands(h: np.ndarray, least: float = LEAST, hashes: int = HASHES) -> list[int]:
    """Bucket keys of a set: of its own partition, and of the next if a partner there can be small enough."""
    n, sig, out = len(h), minhash(h, hashes), []
    own = partition(n)
    for k in (own, own + 1) if math.floor(n / least + 1e-9) >= 2 ** (own + 1) else (own,):
        count, rows = banding(k, least, hashes)
        with np.errstate(over="ignore"):
            part = common.mix(sig[: count * rows].reshape(count, rows) + np.arange(1, rows + 1, dtype=np.uint64))
            key = np.zeros(count, np.uint64)
            for j in range(rows):
                key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
            key = common.mix(key + np.uint64(k << 16) + np.arange(count, dtype=np.uint64))
        out += common.signed(key).tolist()
    return out


def _sets(keyed: DataFrame, least: float, hashes: int) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [shingles(t) for t in b["text"]]
            yield {
                "uid": b["uid"], "key": b["key"], "n": [len(h) for h in got],
                "same": [hashlib.md5(h).digest() if len(h) else None for h in got],
                "bands": [bands(h, least, hashes) if len(h) else [] for h in got],
                "low": [common.signed(h[:SAMPLE]).tolist() for h in got],
            }

    return common.map_columns(keyed.select("uid", "key", common.bytes_of("text").alias("text")), run, "uid long, key long, n long, same binary, bands array<long>, low array<long>")


def verify(pairs: DataFrame, texts: DataFrame, least: float = LEAST, of=max) -> DataFrame:
    """The pairs (a, b) whose exact sets have common shingles of at least `least` of the larger set (with of=min, of the smaller)."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        size = 0

        def sets(uid: int, text: bytes) -> np.ndarray:
            nonlocal size
            if uid not in held:
                if size > HELD:
                    held.clear()
                    size = 0
                held[uid] = shingles(text)
                size += len(held[uid])
            return held[uid]

        for b in batches:
            keep = []
            for u, x, v, y in zip(b["a"], b["ta"], b["b"], b["tb"], strict=True):
                one, other = sets(u, x), sets(v, y)
                need = least * max(of(len(one), len(other)), 1) - 1e-9
                keep.append(min(len(one), len(other)) >= need and len(np.intersect1d(one, other, assume_unique=True)) >= need)
            yield {"a": [v for v, k in zip(b["a"], keep, strict=True) if k], "b": [v for v, k in zip(b["b"], keep, strict=True) if k]}

    t = lambda x: texts.select(F.col("uid").alias(x), F.col("body").alias(f"t{x}"))
    return common.map_columns(pairs.join(t("a"), "a").join(t("b"), "b"), run, "a long, b long")


def prefix_pairs(open_: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of different labels, among the texts of open_ (uid, label), that can be linked at all.

    The exact way for buckets that one centre does not settle. With all shingles in one order, rarest first, linked
    sets of n shingles at most share one of their first n - ceil(least n) + 1. A shingle that one text alone
    has links nothing, so only shared ones are ordered and kept.
    """

    def run(batches):
        for b in batches:
            got = [shingles(t) for t in b["body"]]
            yield {"uid": b["uid"], "label": b["label"], "n": [len(h) for h in got], "h": [common.signed(h).tolist() for h in got]}

    sets = common.cut(common.map_columns(texts.join(open_, "uid").select("uid", "label", "body"), run, "uid long, label long, n long, h array<long>"))
    rows = sets.select("uid", "n", F.explode("h").alias("h"))
    shared = common.cut(rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    ordered = rows.join(shared, "h").groupBy("uid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    first = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("s"))).cast("int")
    heads = ordered.select("uid", "n", F.size("s").alias("shared"), F.posexplode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "x"))
    heads = heads.select("uid", "n", (F.col("shared") - F.col("at")).alias("rest"), F.col("x.h").alias("h"))  # rest: shingles from here on
    heads = common.cut(heads.join(open_, "uid"))
    mixed = common.cut(heads.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("h"))
    heads = common.cut(heads.join(mixed, "h"))
    common.discard(sets, shared)
    room = F.least("x.rest", "y.rest") >= F.ceil(F.lit(least) * F.greatest("x.n", "y.n") - 1e-9)  # true at the first common shingle of a linked pair
    return heads.alias("x").join(heads.alias("y"), "h").filter("x.label != y.label and x.uid > y.uid").filter(room).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct()


def _range(h: np.ndarray) -> np.ndarray:
    """The range of each hash: its leading zero bits, RANGES - 1 at most."""
    return np.minimum(16 - np.frexp((h >> np.uint64(48)).astype(np.float64))[1], RANGES - 1)


class BitTable:
    """Bits for hashes, `counts` of them by range: a range of L of all lookups and S of the hashes gets room by sqrt(L S), which lets the fewest others pass."""

    def __init__(self, counts: np.ndarray):
        share = np.sqrt(counts * 0.5 ** np.arange(1, RANGES + 1))
        bits = min(FILTER_BITS, max(1 << 16, 1 << int(16 * counts.sum()).bit_length()))
        self.size = np.maximum(64, share / max(share.sum(), 1e-9) * bits).astype(np.uint64)
        self.base = np.cumsum(self.size) - self.size
        self.segment = min(bits // 8, 1 << 18)
        self.segments = -(-int(self.size.sum()) // (8 * self.segment))
        self.table = None

    def empty(self) -> np.ndarray:
        return np.zeros(self.segments * self.segment, np.uint8)

    def at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and bit in it of each hash."""
        r = _range(h)
        spot = self.base[r] + h % self.size[r]
        return spot >> np.uint64(3), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        byte, bit = self.at(h)
        return self.table[byte] & bit != 0


def _flat(lists) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _bit_table(low: DataFrame) -> BitTable:
    """A table of the hashes in the arrays `low`. Tasks set bits in tables of their own, which are joined by segment."""

    def count(batches):
        n = np.zeros(RANGES, np.int64)
        for b in batches:
            n += np.bincount(_range(_flat(b["low"])), minlength=RANGES)
        yield {"k": list(range(RANGES)), "n": n.tolist()}

    counts = np.zeros(RANGES, np.int64)
    for r in common.map_columns(low.select("low"), count, "k int, n long", ("low",)).groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r.k] = r.n
    out = BitTable(counts)

    def part(batches):
        own = out.empty()
        for b in batches:
            np.bitwise_or.at(own, *out.at(_flat(b["low"])))
        own = own.reshape(out.segments, out.segment)
        for k in np.flatnonzero(own.any(axis=1)).tolist():
            yield {"k": [k], "bits": [own[k].tobytes()]}

    def join(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["k"], b["bits"], strict=True):
                own[k] = own.get(k, np.uint8(0)) | np.frombuffer(x, np.uint8)
        for k, x in own.items():
            yield {"k": [k], "bits": [x.tobytes()]}

    parts = common.map_columns(low.select("low"), part, "k int, bits binary", ("low",)).repartition("k")
    table = out.empty().reshape(out.segments, out.segment)
    for r in common.map_columns(parts, join, "k int, bits binary").toLocalIterator():
        table[r.k] = np.frombuffer(bytes(r.bits), np.uint8)
    out.table = table.reshape(-1)
    return out


def _lookups(texts: DataFrame, held) -> DataFrame:
    """(uid, n, h): the shingles of every text whose bit is set in the broadcast table `held`."""

    def run(batches):
        here = held.value
        for b in batches:
            uids, ns, hs = ([np.zeros(0, np.int64)] for _ in range(3))
            for uid, text in zip(b["uid"], b["text"], strict=True):
                h = shingles(text)
                own = h[here.has(h)]
                uids.append(np.full(len(own), uid, np.int64))
                ns.append(np.full(len(own), len(h), np.int64))
                hs.append(common.signed(own))
            yield {"uid": np.concatenate(uids), "n": np.concatenate(ns), "h": np.concatenate(hs)}

    return common.map_columns(texts.select("uid", common.bytes_of("text").alias("text")), run, "uid long, n long, h long")


def _offers(low: DataFrame, texts: DataFrame, need) -> tuple[DataFrame, DataFrame]:
    """(heads, rows) for hashes `low` (uid, n, low) that stand for sets and all shingles of texts (uid, text).

    A set is left if `need` of its hashes stand in larger sets; its head is so many of them, rarest first, that a holder has
    one. rows: (uid, n, h) of all texts for the hashes in heads.
    """
    held = low.sparkSession.sparkContext.broadcast(_bit_table(low))
    rows = common.cut(_lookups(texts, held))
    held.destroy()
    # sums are tables of their own, as above
    several = common.cut(rows.groupBy("h").agg(F.count("*").alias("df"), F.max("n").alias("largest")).filter("df > 1"))
    sample = low.select("uid", "n", F.explode("low").alias("h")).join(several, "h").filter("largest > n")
    sample = sample.groupBy("uid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))  # as many as `low` has
    heads = common.cut(sample.withColumn("first", (F.size("s") - need + 1).cast("int")).filter("first > 0").select("uid", "n", F.explode(F.expr("slice(s, 1, first)")).alias("x")).select("uid", "n", "x.h"))
    wanted = common.cut(heads.select("h").distinct())
    found = common.cut(common.among(rows, wanted, "h"))
    common.discard(rows, several)
    return heads, found


def holders(firsts: DataFrame, sets: DataFrame, keyed: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of the representatives `firsts` (uid, n) of groups, where the larger set of b has `least` of a's.

    Once with samples over all texts, then with whole sets over the texts that this leaves, then pair by pair.
    """
    gone = common.cut(sets.filter("n > 0").select("uid").join(firsts, "uid", "left_anti"))
    low = common.cut(common.without(sets.filter("n > 0").select("uid", "n", "low"), gone, "uid"))
    whole = F.ceil(F.lit(least) * F.col("n") - 1e-9)
    heads, rows = _offers(low, common.without(keyed.select("uid", "text"), gone, "uid"), F.when(F.col("n") <= SAMPLE, whole).otherwise(math.ceil(SAMPLE_NEED * least / LEAST)))
    few, some = common.cut(heads.select("uid").distinct()), common.cut(rows.select("uid").distinct())
    common.discard(low, heads, rows)
    texts = common.cut(common.among(keyed.select("uid", "text"), some, "uid"))

    def run(batches):
        for b in batches:
            got = [shingles(t) for t in b["text"]]
            yield {"uid": b["uid"], "n": [len(h) for h in got], "low": [common.signed(h).tolist() for h in got]}

    full = common.cut(common.map_columns(common.among(texts, few, "uid").select("uid", common.bytes_of("text").alias("text")), run, "uid long, n long, low array<long>"))
    heads, rows = _offers(full, texts, whole)
    pairs = common.cut(heads.alias("x").join(rows.alias("y"), "h").filter("x.n < y.n").select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct())
    return common.cut(verify(pairs, _texts(texts, pairs), least, min))


def _texts(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, body) of the texts in pairs (a, b), a table."""
    wanted = common.cut(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct())
    return common.cut(common.among(keyed.select("uid", common.bytes_of("text").alias("body")), wanted, "uid"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of the undirected edges (a, b) the least node of its component."""
    edges = common.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    digest = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    now = digest(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = common.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))  # a table, so that the join can be split at a node of many edges
        large = both.filter("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = common.cut(large)
        low = common.cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges, before = common.cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), now
        now = digest(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def groups(keyed: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(uid, key, n, rep, class_uid): class_uid is the same for all documents of a near-copy group, rep for all of equal sets."""
    slim = sets.select("uid", "key", "n", "same")
    reps = common.cut(sets.filter("same is not null").groupBy("same").agg(F.min("uid").alias("rep")))
    members = common.cut(slim.join(reps, "same", "left").select("uid", "key", "n", F.coalesce("rep", "uid").alias("rep")))
    copies = common.cut(members.filter("uid != rep").select("uid"))
    buckets = common.cut(common.without(sets.select("uid", "bands"), copies, "uid").select("uid", F.explode("bands").alias("band")))
    # sums are tables of their own: a join with them has two plain sides, which adaptive execution can split at a hot key
    ends = common.cut(buckets.groupBy("band").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).filter("lo < hi"))
    full = common.cut(common.among(buckets, ends, "band"))  # buckets of two texts or more
    # one centre for each bucket: the least uid
    star = ends.select("band", F.col("lo").alias("b")).join(full, "band").select(F.col("uid").alias("a"), "b").filter("a != b").distinct()
    tested = common.cut(star)
    texts = _texts(keyed, tested)
    links = common.cut(verify(tested, texts, least))
    labels = components(links)
    labelled = common.cut(full.join(labels.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "band", F.coalesce("label", "uid").alias("label")))
    mixed = common.cut(labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band"))
    open_ = common.cut(labelled.join(mixed, "band").groupBy("uid").agg(F.first("label").alias("label")))
    links = links.unionByName(common.cut(verify(prefix_pairs(open_, texts, least).join(tested, ["a", "b"], "left_anti"), texts, least)))
    labels = components(links)
    common.discard(buckets, ends, full, tested, texts, labelled, mixed, open_)
    return members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("uid", "key", "n", "rep", F.coalesce("label", "rep").alias("class_uid"))


def report(docs: DataFrame, least: float = LEAST, hashes: int = HASHES) -> DataFrame:
    """One row for each document: doc_id, class_id, n_shingles, held_by, n_holders."""
    keyed = common.keyed(common.pick(docs, "doc_id", "text"))
    sets = common.cut(_sets(keyed, least, hashes))
    got = common.cut(groups(keyed, sets, least))
    firsts = _firsts(got, sets)
    held = holders(firsts, sets, keyed, least).join(firsts.select(F.col("uid").alias("b"), F.col("key").alias("holder")), "b").groupBy("a").agg(F.min("holder").alias("holder"), F.count("*").alias("n_holders"))
    ids = common.cut(firsts.join(held.withColumnRenamed("a", "uid"), "uid", "left").select("class_uid", F.col("key").alias("class_key"), "holder", "n_holders"))
    real = lambda c: F.when(F.col(c) != common.NULL_ID, F.col(c))
    got = got.join(ids, "class_uid")
    return got.select(real("key").alias("doc_id"), real("class_key").alias("class_id"), F.col("n").alias("n_shingles"), real("holder").alias("held_by"), F.coalesce("n_holders", F.lit(0)).alias("n_holders"))


def _firsts(got: DataFrame, sets: DataFrame) -> DataFrame:
    """(class_uid, key, uid, n) of each group's representative: smallest key, then smallest set digest, then any of these equal rows."""
    ordered = got.select("class_uid", "uid").join(sets.select("uid", "key", "same", "n"), "uid")
    return common.cut(ordered.groupBy("class_uid").agg(F.min(F.struct("key", "same", "uid", "n")).alias("b")).select("class_uid", "b.key", "b.uid", "b.n"))


def keep_one(docs: DataFrame, least: float = LEAST, hashes: int = HASHES, drop_held: bool = True) -> DataFrame:
    """docs without all but the representative of each group, and without those that a larger one holds, which stays or is held by a larger one itself.

    With drop_held = False, near copies of about equal size alone go.
    """
    keyed = common.keyed(docs)
    sets = common.cut(_sets(keyed, least, hashes))
    left = _firsts(common.cut(groups(keyed, sets, least)), sets)
    if drop_held:
        left = left.join(holders(left, sets, keyed, least).select(F.col("a").alias("uid")).distinct(), "uid", "left_anti")
    gone = common.cut(sets.select("uid").join(left, "uid", "left_anti"))
    return common.unkeyed(common.without(keyed, gone, "uid"), docs)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
