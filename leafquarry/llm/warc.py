"""WARC files of pages and a Merkle audit of their replicas.

`write_warc` writes gzip-compressed WARC/1.0 files (FILE_RECORDS `resource` records and FILE_BYTES at most, in order of page_id) with
Spark's own writers, several replicas in one job; `read_warc` parses such files from any store that Spark reads. `audit`
compares two replicas: each record's hash with its range of offsets is a leaf, FANOUT neighbours make a node, up to one root a
file. Roots are compared first; below a root or node that differs, and only there, the children of both replicas are
compared, down to the records.

Damage never ends the job. Bytes that are no record (a length that does not fit, a lost header) make one row with `error` up to
the next place where a record begins; of a file that can't be unpacked to its end the rows before stand, then one with `error`. A file over
READ_BYTES is a row with `error`. Such rows differ from the other replica's, and so do records and files that one replica lacks.

Defined results: a null url, html or page_id is written as an empty one; pages with equal ids are records of their own,
ordered by url, then html; a block of ids with more rows or bytes than a file should hold is dealt over several files; an
empty table gives no file and no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import common

FILE_RECORDS, FILE_BYTES, FANOUT = 1000, 64 << 20, 16
#: Packed bytes of the largest file that is read.
READ_BYTES = 1 << 30
_LENGTH = re.compile(rb"(?mi)^Content-Length: *(\d+)\r$")
_FIELD = {k: re.compile(rb"(?mi)^" + k.encode() + rb": *(.*)\r$") for k in ("WARC-Record-ID", "WARC-Target-URI")}
_FILE = re.compile(r"file=([0-9A-Za-z_-]+)/")


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A whole WARC record as text."""
    body, text = F.coalesce(html, F.lit("")), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text(page_id), F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def with_file(pages: DataFrame, per_file: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, url, html with the file (block of ids, part of it) that each page goes to. For one job: parts go by the rows' numbers, too."""
    block = F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1))
    pages = common.pick(pages, "page_id", "url", "html").withColumns({"block": block, "number": F.monotonically_increasing_id()})
    size = F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + 200)
    parts = common.cut(pages.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / per_file), F.ceil(size / file_bytes)).alias("parts")).filter("parts > 1"))
    if parts.isEmpty():
        part = F.lit(0)
    else:
        pages = pages.join(parts, "block", "left")
        part = F.pmod(F.xxhash64("page_id", "url", "number"), F.coalesce("parts", F.lit(1)))
    return pages.select("page_id", "url", "html", F.concat_ws("_", F.col("block"), part).alias("file"))


def write_warc(filed: DataFrame, path: str, replicas: dict[str, Column] | None = None, order: tuple[str, ...] = ("page_id", "url", "html")) -> dict[str, str]:
    """Write pages with their `file` below path, once for each replica (name: what stands for html in it); gives the replicas' paths.

    Pages are dealt out by file once, whatever the number of replicas.
    """
    replicas = replicas or {"one": F.col("html")}
    dealt = filed.repartition("file")
    copies = F.explode(F.array(*[F.struct(F.lit(name).alias("replica"), body.alias("body")) for name, body in replicas.items()]))
    rows = dealt.select("file", *order, copies.alias("r")).select("r.replica", "file", *order, record(F.col("page_id"), F.col("url"), F.col("r.body")).alias("value"))
    rows = rows.sortWithinPartitions("replica", "file", *order)
    # a record ends with a newline, which the writer puts
    rows.select("replica", "file", F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.partitionBy("replica", "file").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return {name: f"{path}/replica={name}" for name in replicas}


def unpack(raw: bytes) -> tuple[bytes, str | None]:
    """What a gzip file (of one or more members) holds, and why it ends before its end."""
    out, one = [], zlib.decompressobj(31)
    step = 1 << 16
    for lo in range(0, len(raw), step):
        left = raw[lo : lo + step]
        while left:
            before = one.copy()
            try:
                out.append(one.decompress(left))
            except zlib.error as e:
                for k in range(0, len(left), 64):  # as far as it goes
                    try:
                        out.append(before.decompress(left[k : k + 64]))
                    except zlib.error:
                        break
                return b"".join(out), str(e)
            left = one.unused_data
            if one.eof and (left or lo + step < len(raw)):
                one = zlib.decompressobj(31)
    return b"".join(out), None if one.eof else "the file ends too early"


def records(data: bytes, broken: str | None):
    """(offset, end, end of the header or None, error) of the records in data."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = _LENGTH.search(data, at, head + 2) if head >= 0 else None
        end = head + 8 + int(size[1]) if size else 0
        if data.startswith(b"WARC/", at) and size and end <= len(data) and data[end - 4 : end] == b"\r\n\r\n" and (end == len(data) or data.startswith(b"WARC/", end)):
            yield at, end, head + 2, None
        else:
            after = data.find(b"\r\n\r\nWARC/", at + 1)
            end = after + 4 if after >= 0 else len(data)
            yield at, end, head + 2 if 0 <= head < end else None, "no whole record"
        at = end
    if broken:
        yield at, at, None, broken


RECORD = "file string, ordinal long, record_id string, url string, offset long, length long, sha256 string, error string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: file, ordinal, record_id, url, offset and length (uncompressed bytes), sha256 of the whole record, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    name = lambda p: m[1] if (m := _FILE.search(p)) else p

    def run(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                data, broken = unpack(raw)
                out = {c.split()[0]: [] for c in RECORD.split(", ")}
                for n, (lo, hi, head, error) in enumerate(records(data, broken)):
                    find = lambda k: m[1].decode("utf-8", "replace") if head and (m := _FIELD[k].search(data, lo, head)) else None  # noqa: B023, E731
                    for c, v in zip(out, (name(p), n, find("WARC-Record-ID"), find("WARC-Target-URI"), lo, hi - lo, hashlib.sha256(data[lo:hi]).hexdigest(), error), strict=True):
                        out[c].append(v)
                yield out

    read = common.map_columns(files.filter(F.col("length") <= READ_BYTES).select("path", "content"), run, RECORD)
    nothing = lambda t: F.lit(None).cast(t)
    large = files.filter(F.col("length") > READ_BYTES).select(
        F.coalesce(F.nullif(F.regexp_extract("path", _FILE.pattern, 1), F.lit("")), "path").alias("file"), F.lit(0).cast("long").alias("ordinal"), nothing("string").alias("record_id"), nothing("string").alias("url"),
        F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), nothing("string").alias("sha256"), F.lit("the file is too large to be read").alias("error"),
    )
    return read.unionByName(large)


def tree(rows: DataFrame) -> DataFrame:
    """Nodes of the files' Merkle trees: file, level (0: records), idx, lo, hi (range of offsets), hash. All levels of a file in one pass over its records."""

    def build(key, table):
        import pyarrow as pa

        table = table.sort_by("ordinal").to_pydict()
        name = lambda lo, hi, h: hashlib.sha256(f"{lo}:{hi}:{h}".encode()).hexdigest()
        level = [(i, lo, lo + n, name(lo, lo + n, f"{h} {e or ''}")) for i, lo, n, h, e in zip(table["ordinal"], table["offset"], table["length"], table["sha256"], table["error"], strict=True)]
        k, out = 0, {c: [] for c in ("file", "level", "idx", "lo", "hi", "hash")}
        while True:
            for node in level:
                for c, v in zip(out, (key[0].as_py(), k, *node), strict=True):
                    out[c].append(v)
            if level[-1][0] == 0:
                return pa.table(out, schema=common.schema_of_ddl(_NODE))
            kids: dict[int, list] = {}
            for node in level:
                kids.setdefault(node[0] // FANOUT, []).append(node)
            level = [(i, c[0][1], c[-1][2], name(c[0][1], c[-1][2], ",".join(f"{x[0]}={x[3]}" for x in c))) for i, c in kids.items()]
            k += 1

    return rows.select("file", "ordinal", "offset", "length", "sha256", "error").groupBy("file").applyInArrow(build, _NODE)


_NODE = "file string, level int, idx long, lo long, hi long, hash string"


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """(file, ordinal) of records that differ between two replicas' records."""
    a, b = common.cut(tree(one)), common.cut(tree(two))
    root = lambda t, h: t.groupBy("file").agg(F.max("level").alias(f"top{h}"), F.max_by("hash", "level").alias(h))
    files = root(a, "ha").join(root(b, "hb"), "file", "full").filter("not (ha <=> hb and topha <=> tophb)").select("file", F.greatest("topha", "tophb").alias("top"))
    files = common.cut(files)
    bad, out = None, None
    for level in range(files.agg(F.max("top")).first()[0] or 0, -1, -1):
        # tops of the files that begin here, and children of what differs above
        tops = files.filter(F.col("top") == level).select("file", F.lit(0).cast("long").alias("up"))
        above = common.cut(tops if bad is None else tops.unionByName(bad.select("file", F.col("idx").alias("up"))))

        def side(t: DataFrame, h: str, level=level, above=above) -> DataFrame:
            nodes = t.filter(F.col("level") == level).select("file", "idx", F.floor(F.col("idx") / FANOUT).alias("up"), F.col("hash").alias(h))
            return nodes.join(above, ["file", "up"], "left_semi").drop("up")

        bad = common.cut(side(a, "ha").join(side(b, "hb"), ["file", "idx"], "full").filter("not (ha <=> hb)").select("file", "idx"))
        out = bad
    return out.select("file", F.col("idx").alias("ordinal"))


#: The replica that the query audits: pages of these ids have one byte of their html changed on it.
ROT = "coalesce(page_id % 97 = 13, false) and length(html) > 0"


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = with_file(common.table(spark, sf_dir, "pages"))
    rotten = F.when(F.expr(ROT), F.expr("overlay(html placing '~' from 1 for 1)")).otherwise(F.col("html"))
    paths = write_warc(filed, common.scratch(spark), {"one": F.col("html"), "two": rotten})
    first, second = (common.cut(read_warc(spark, paths[k])) for k in ("one", "two"))
    bad = audit(first, second).withColumn("damaged", F.lit(True))
    out = first.join(bad, ["file", "ordinal"], "left")
    return out.select(F.expr("try_cast(regexp_extract(record_id, '<urn:page:(.*)>', 1) as bigint)").alias("page_id"), "url", "file", "ordinal", F.col("offset").alias("start"), "length", "sha256", F.coalesce("damaged", F.lit(False)).alias("damaged"))


ORACLE = f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    CAST(coalesce(page_id // {FILE_RECORDS}, -1) AS VARCHAR) || '_0' AS file,
    concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
      'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
      'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS rec
  FROM pages)
SELECT page_id, url, file, row_number() OVER w - 1 AS ordinal,
  CAST(coalesce(sum(strlen(rec)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha256, coalesce(page_id % 97 = 13, false) AND length(html) > 0 AS damaged
FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id, url, html)
"""
