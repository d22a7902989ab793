"""Shared pieces of the corpus operators: scratch tables, Arrow batches, words and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id when documents are ordered: after every real id.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Where the setting is absent, a temporary folder is set for a session whose executors are threads of the
    driver; on a cluster that would lose results, and is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="leafquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leafquarry/{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to a table in the shared folder and read it back.

    What follows no longer depends on shuffle files or on recomputing df, so a lost
    executor costs only the tasks that it ran. `discard` deletes large ones when they are done with; the
    rest belongs to the cluster's checkpoint area and is cleaned with it.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lq_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `cut` that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.lq_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: The most words of 64 bits in a table of marks, which is broadcast (16 MB), whatever the input. With more values than bits nearly all rows pass and are shuffled, to the same result.
MARK_WORDS = 1 << 20


def _may_be(values: DataFrame, by: str) -> tuple[DataFrame, F.Column]:
    """A table of bits for the values of column `by`, to be broadcast, and the condition that a row's value may be one of them."""
    words = min(MARK_WORDS, max(1 << 10, 1 << (values.count() // 4).bit_length()))  # 16 bits a value
    word, bit = f"pmod(shiftright(xxhash64({by}), 6), {words})", f"cast(pmod(xxhash64({by}), 64) as int)"
    marks = values.select(F.expr(word).alias("lq_word"), F.expr(f"shiftleft(1L, {bit})").alias("lq_bits")).groupBy("lq_word").agg(F.bit_or("lq_bits").alias("lq_bits"))
    return F.broadcast(marks), F.expr(f"{word} = lq_word and getbit(lq_bits, {bit}) = 1")


def narrowed(df: DataFrame, values: DataFrame, by: str) -> DataFrame:
    """df without most rows whose column `by` is not in the table `values`: what is joined with that next, so that few texts of many are shuffled."""
    marks, may = _may_be(values, by)
    return df.join(marks, may, "left_semi")


def among(df: DataFrame, values: DataFrame, by: str) -> DataFrame:
    """The rows of df whose column `by` is in the table `values`."""
    return narrowed(df, values, by).join(values.select(by), by, "left_semi")


def without(df: DataFrame, values: DataFrame, by: str) -> DataFrame:
    """The rows of df whose column `by` is not in the table `values`. Only rows that may be are shuffled; df is read twice."""
    marks, may = _may_be(values, by)
    return df.join(marks, may, "left_anti").unionByName(df.join(marks, may, "left_semi").join(values.select(by), by, "left_anti"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of its own for each row in the column `name`, written once.

    Numbers are given in the one job that writes the table. Everything later reads them from there, so they
    stay the same however the input is split when it is read again.
    """
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def keyed(docs: DataFrame) -> DataFrame:
    """A numbered table of docs with uid, key (doc_id, null ids last) and text; the other columns are c0, c1, ... by place, as they may have any names."""
    at = {c: i for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*["text" if i == at["text"] else f"c{i}" for i in range(len(docs.columns))])
    return numbered(inner.withColumn("key", F.coalesce(f"c{at['doc_id']}", F.lit(NULL_ID))), "uid")


def unkeyed(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows of keyed(docs)."""
    return keyed.select(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]).toDF(*docs.columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any letter case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


#: Arrow data that a function sees at a time; one row may be larger.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, int(b.num_rows * SLICE_BYTES / max(b.nbytes, 1)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


_held: dict = {}


def hold(name, make: Callable):
    """The one large object that a worker keeps between tasks. Asking for another one lets it go, as workers serve one operator after the other."""
    if name not in _held:
        _held.clear()
        settle()
        _held[name] = make()
    return _held[name]


def settle() -> None:
    """Give memory that is free back to the system at the end of a task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_columns(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str, arrays: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over Python lists: fn gets an iterator of {column: list} and yields the same.

    fn gets slices of SLICE_BYTES or so, so a partition is never held as a whole. Columns named in `arrays` stay Arrow arrays.
    """
    target = schema_of(df.sparkSession, schema)

    def run(batches):
        names = [f.name for f in target]
        lists = ({c: b.column(i) if c in arrays else b.column(i).to_pylist() for i, c in enumerate(b.schema.names)} for b in slices(batches))
        for out in fn(lists):
            for lo in range(0, max(1, len(out[names[0]])), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name][lo : lo + 20_000], type=f.type) for f in target], names=names)
        settle()

    return df.mapInArrow(run, schema)


def schema_of_ddl(ddl: str) -> pa.Schema:
    """The Arrow schema of flat columns, without a session, as workers have none."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(","))])


def schema_of(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


#: Bytes outside the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z become spaces; every byte of a
#: multi-byte UTF-8 character is 0x80 or more and so belongs to words.
_LOWER = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; none for null."""
    return text.translate(_LOWER).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but U+0020 and U+0009 to U+000D; none for null."""
    return text.split() if text else []


_xxh = xxhash.xxh3_64_intdigest


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return np.fromiter(map(_xxh, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive word hashes.

    A polynomial of the mixed word hashes over the ring of 64-bit integers, built by doubling
    (each step joins two runs), then mixed once more.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    with np.errstate(over="ignore"):
        part, size, power = mix(h + np.uint64(seed)), 1, base
        total, done = np.zeros(n, np.uint64), 0
        rest = width
        while rest:
            if rest & 1:
                total = total * power + part[done : done + n]
                done += size
            rest >>= 1
            if rest:
                part = part[:-size] * power + part[size:]
                size, power = size * 2, power * power
        return mix(total)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bytes_of(col: str) -> F.Column:
    return F.col(col).cast("binary")


def append_columns(df: DataFrame, needs: list[str], fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """df with the columns of `schema` behind its own, row by row.

    fn gets an iterator of {needed column: list} (strings as bytes) and yields {new column: list} for
    each; the other columns pass through as Arrow arrays. Names that df has already are given by callers.
    """
    from pyspark.sql.types import StructType

    extra = schema_of(df.sparkSession, schema)
    full = StructType([*df.schema.fields, *StructType.fromDDL(schema).fields])

    def run(batches):
        seen = []

        def lists():
            for b in slices(batches):
                seen.append(b)
                yield {c: (b.column(c).cast(pa.binary()) if pa.types.is_string(b.column(c).type) or pa.types.is_large_string(b.column(c).type) else b.column(c)).to_pylist() for c in needs}

        for out in fn(lists()):
            b = seen.pop(0)
            new = [pa.array(out[f.name], type=f.type) for f in extra]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *extra.names])
        settle()

    return df.mapInArrow(run, full)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others cannot clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])
