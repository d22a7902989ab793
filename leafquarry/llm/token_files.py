"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

File format. A table in the shared folder whose rows are shards, in ascending doc_id order (null ids
last; ties by crc, then length). A shard holds up to SHARD_DOCS documents or SHARD_BYTES:

    part, shard     place of the shard: range partition, number in it
    dict_sha256     of the dictionary that its frames need
    n_tokens        ids in the shard
    doc_ids         little-endian int64 array; null ids are INT64_MAX with a zero in `known`
    known           one byte a document: 1 if its doc_id is not null
    counts          little-endian uint32 array: ids of each document
    crcs            little-endian uint32 array: crc32 of each document's ids as little-endian uint32, compared by readers
    offsets         little-endian uint64 array of n + 1 places: frame i is data[offsets[i]:offsets[i + 1]]
    data            the frames, each an independent zstandard frame of little-endian uint16 ids
                    (uint32 where the vocabulary needs it; `width` has the bytes of an id)

One document is read by slicing two offsets and decompressing one frame. The dictionary itself is
a one-row table beside it, with its hash, its kind (trained, content, none) and the width of ids.

Defined results: a null or empty text has the end id alone; repeated rows are documents of their own;
an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafquarry.llm import common, tokens

SHARD_DOCS, SHARD_BYTES = 4096, 16 << 20
#: The dictionary is trained on whole id arrays of this many documents at most, and on at most so many bytes of them (one document at least).
#: It decides the size of the frames, never their content.
DICT_DOCS, DICT_SAMPLE_BYTES, DICT_BYTES = 1000, 4 << 20, 64 << 10
LEVEL = 3


def width_of(tokenizer_path: str | None = None) -> int:
    """Bytes of an id in the files: 2 where every id of the vocabulary and the end id fit."""
    return 2 if max(tokens.encoder(tokenizer_path).size - 1, tokens.END) < 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_path: str | None = None, n_docs: int = DICT_DOCS) -> tuple[str, bytes]:
    """(kind, dictionary) from whole id arrays of the documents whose ids have the smallest hashes, of any length, up to DICT_SAMPLE_BYTES.

    kind is `trained`; where the library can't train on so little, `content`: the sample itself, to which frames
    refer as well; `none` for an empty table.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("key"), "text")
    keys = [r[0] for r in keyed.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(n_docs).collect()]
    if not keys:
        return "none", b""
    kind = f"<u{width_of(tokenizer_path)}"

    def run(batches):
        for b in batches:
            ids, at = tokens.encoder(tokenizer_path).encode(b["text"])
            yield {"key": b["key"], "ids": [ids[lo:hi].astype(kind).tobytes() for lo, hi in zip(at.tolist(), at[1:].tolist(), strict=False)]}

    one = keyed.filter(F.col("key").isin(keys)).groupBy("key").agg(F.min("text").alias("text"))
    samples, size = [], 0
    for r in common.map_columns(one, run, "key long, ids binary", arrays=("text",)).orderBy(F.xxhash64("key"), "key").toLocalIterator():
        if size + len(r.ids) <= DICT_SAMPLE_BYTES or not samples:
            size += len(r.ids)
            samples.append(bytes(r.ids))
    try:
        return "trained", zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return "content", b"".join(samples)[:DICT_BYTES]


def _dictionary(kind: str, raw: bytes):
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if kind == "trained" else zstandard.DICT_TYPE_RAWCONTENT) if raw else None


def encode_documents(docs: DataFrame, kind: str, dictionary: bytes, width: int, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, crc, frame): one compressed frame a document."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(kind, dictionary))
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_tokens": [], "crc": [], "frame": []}
            ids, at = tokens.encoder(tokenizer_path).encode(b["text"])
            slim, at = ids.astype(f"<u{width}"), at.tolist()
            for lo, hi in zip(at, at[1:], strict=False):
                out["n_tokens"].append(hi - lo)
                out["crc"].append(zlib.crc32(ids[lo:hi]))
                out["frame"].append(press.compress(slim[lo:hi]))
            yield out

    return common.map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, crc long, frame binary", arrays=("text",))


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None) -> str:
    """Encode docs and write shards and dictionary below path (default: a new folder of the shared area); gives the path.

    Encoded frames go to the shared folder once; only they are dealt by range of doc_id (the tie columns
    keep a doc_id with very many rows from landing in one task).
    """
    spark, width = docs.sparkSession, width_of(tokenizer_path)
    path, (how, raw) = path or common.scratch(spark), train_dictionary(docs, tokenizer_path)
    sha = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(sha, bytearray(raw), how, width)], "dict_sha256 string, dictionary binary, kind string, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = common.cut(encode_documents(docs, how, raw, width, tokenizer_path), "none")
    dealt = frames.withColumn("key", F.coalesce("doc_id", F.lit(common.NULL_ID))).repartitionByRange("key", "crc", "n_tokens").sortWithinPartitions("key", "crc", "n_tokens")

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def close():
            ids, counts, data = [h[0] for h in held], [h[1] for h in held], [h[2] for h in held]
            return {
                "part": [part], "shard": [shard], "dict_sha256": [sha], "n_tokens": [sum(counts)],
                "doc_ids": [np.array([common.NULL_ID if i is None else i for i in ids], "<i8").tobytes()],
                "known": [bytes(i is not None for i in ids)],
                "counts": [np.array(counts, "<u4").tobytes()],
                "crcs": [np.array([h[3] for h in held], "<u4").tobytes()],
                "offsets": [np.cumsum([0, *map(len, data)]).astype("<u8").tobytes()],
                "data": [b"".join(data)],
            }

        for b in batches:
            for row in zip(b["doc_id"], b["n_tokens"], b["frame"], b["crc"], strict=True):
                held.append(row)
                size += len(row[2])
                if len(held) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield close()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield close()

    shards = common.map_columns(dealt.select("doc_id", "n_tokens", "frame", "crc"), run, "part int, shard int, dict_sha256 string, n_tokens long, doc_ids binary, known binary, counts binary, crcs binary, offsets binary, data binary")
    shards.write.option("compression", "none").parquet(f"{path}/shards")
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, dict_sha256; with ids array<int> on request.

    start counts the ids of all documents before it: sums of range partitions (one row each), then of
    the shards in a partition, then within a shard.
    """
    known = spark.read.parquet(f"{path}/dictionary").limit(1).collect()[0]
    raw, sha, how, kind = bytes(known.dictionary), known.dict_sha256, known.kind, f"<u{known.width}"
    if hashlib.sha256(raw).hexdigest() != sha:
        raise ValueError("the dictionary does not have its own hash")
    shards = spark.read.parquet(f"{path}/shards")

    def run(batches):
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(how, raw))
        for b in batches:
            for i, data in enumerate(b["data"]):
                if b["dict_sha256"][i] != sha:
                    raise ValueError(f"shard {b['part'][i]}/{b['shard'][i]} needs another dictionary")
                ids, have, counts, crcs, at = np.frombuffer(b["doc_ids"][i], "<i8"), b["known"][i], np.frombuffer(b["counts"][i], "<u4"), np.frombuffer(b["crcs"][i], "<u4"), np.frombuffer(b["offsets"][i], "<u8").astype(int)
                before = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
                out = {"part": [b["part"][i]] * len(ids), "shard": [b["shard"][i]] * len(ids), "doc_id": [int(x) if k else None for x, k in zip(ids, have, strict=True)], "inside": before[:-1].tolist(), "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                for j in range(len(ids)):
                    got = np.frombuffer(open_.decompress(data[at[j] : at[j + 1]]), kind).astype("<u4")
                    if len(got) != counts[j] or (crc := zlib.crc32(got)) != crcs[j]:
                        raise ValueError(f"document {ids[j]} does not have the ids that it was written with")
                    out["n_tokens"].append(len(got))
                    out["ids_crc32"].append(crc)
                    if with_ids:
                        out["ids"].append(got.astype(np.int32).tolist())
                yield out

    read = common.map_columns(shards.select("part", "shard", "dict_sha256", "doc_ids", "known", "counts", "crcs", "offsets", "data"), run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    sums = shards.select("part", "shard", "n_tokens")
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(to_here(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inner = sums.select("part", "shard", F.coalesce(F.sum("n_tokens").over(to_here(Window.partitionBy("part").orderBy("shard"))), F.lit(0)).alias("within"))
    places = inner.join(parts, "part")
    return read.join(places, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", F.lit(sha).alias("dict_sha256"), *(["ids"] * with_ids))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(common.table(spark, sf_dir, "documents"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
