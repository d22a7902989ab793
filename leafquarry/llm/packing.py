"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Hierarchical residual packing: every task tokenizes its documents and packs their pieces best-fit (longest
first) into bins of its own; bins that are nearly full are final. The underfull bins go up a tree as items
(id and fill, nothing else): groups of bounded size pack them best-fit again, emit nearly full bins, and
hand on the rest, until one group is left or rounds stop helping.

Defined results: a null or empty text is the end id alone, a document of one id; a document longer than
the capacity is cut from its end, so that its first piece alone may be shorter; repeated rows are documents
of their own; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import common, tokens

CAPACITY = 1024
#: A bin at least this full is final.
NEARLY_FULL = 1008
#: Pieces that a task packs at a time, and bins in a group of the tree.
LOCAL_ITEMS, GROUP = 100_000, 20_000
ROUNDS = 16


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, offset of each item, fill of each bin).

    Bins are kept by free space, and the free spaces in use as bits of one integer, so that the tightest
    fit is the lowest bit at or above the length.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if above := used >> n:
            space = n + (above & -above).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                used ^= 1 << space
        else:
            space, at = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = at, fills[at]
        fills[at] += n
        if left := space - n:
            free[left].append(at)
            used |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids: the first takes what is over."""
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def local_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenize and pack within each task: a row for each piece with its bin, place and the bin's fill."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}

        def pack():
            nonlocal made
            bins, offsets, fills = best_fit(np.array(held["length"], np.int64), capacity)
            out = held | {"bin": ((part << 36) + made + bins).tolist(), "offset": offsets.tolist(), "fill": fills[bins].tolist()}
            made += len(fills)
            return out

        for b in batches:
            every, at = tokens.encoder(tokenizer_path).encode(b["text"])
            for doc, lo, hi in zip(b["doc_id"], at.tolist(), at[1:].tolist(), strict=False):
                ids, start = every[lo:hi], 0
                for piece, n in enumerate(cut_lengths(len(ids), capacity)):
                    for c, v in zip(held, (doc, piece, start, n, zlib.crc32(ids[start : start + n])), strict=True):
                        held[c].append(v)
                    start += n
            if len(held["doc_id"]) >= LOCAL_ITEMS:
                yield pack()
                held = {c: [] for c in held}
        if held["doc_id"]:
            yield pack()

    return common.map_columns(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long", arrays=("text",))


def merge_bins(level: int, capacity: int):
    """Packs the bins of a group as items; ids of the new bins hold the level and the group."""

    def merge(key, rows):
        import pyarrow as pa

        rows = rows.sort_by([("fill", "descending"), ("bin", "ascending")])
        bins, offsets, full = best_fit(rows.column("fill").to_numpy(), capacity)
        parents = (np.int64(level) << np.int64(58)) + (np.int64(key[0].as_py()) << np.int64(24)) + bins
        return pa.table({"bin": rows.column("bin"), "parent": parents, "shift": offsets, "full": full[bins]})

    return merge


def pack(docs: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, group: int = GROUP, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of docs with sequence_id, offset (its place) and sequence_fill."""
    pieces = common.cut(local_pieces(docs, capacity, tokenizer_path))
    under = pieces.filter((F.col("offset") == 0) & (F.col("fill") < nearly_full)).select("bin", "fill")
    spark, moves, n = docs.sparkSession, None, under.count()
    for level in range(1, ROUNDS + 1):
        if n < 2:
            break
        groups = -(-n // group)

        done = under.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups))).groupBy("g").applyInArrow(merge_bins(level, capacity), "bin long, parent long, shift long, full long")
        done = common.cut(done)
        step = done.select("bin", "parent", "shift", "full")
        if moves is None:
            moves = step
        else:
            up = step.select(F.col("bin").alias("parent"), F.col("parent").alias("p2"), F.col("shift").alias("s2"), F.col("full").alias("f2"))
            moves = moves.join(up, "parent", "left").select("bin", F.coalesce("p2", "parent").alias("parent"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift"), F.coalesce("f2", "full").alias("full"))
        under = done.filter((F.col("shift") == 0) & (F.col("full") < nearly_full)).select(F.col("parent").alias("bin"), F.col("full").alias("fill"))
        before, n = n, under.count()
        if groups == 1 or n > 0.98 * before and level > 1:
            break
    if moves is None:
        moves = spark.createDataFrame([], "bin long, parent long, shift long, full long")
    moved = pieces.filter(F.col("fill") < nearly_full).join(moves, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), F.coalesce("full", "fill").alias("sequence_fill"))
    final = pieces.filter(F.col("fill") >= nearly_full).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", F.col("fill").alias("sequence_fill"))
    return final.unionByName(moved)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
