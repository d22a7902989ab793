import gzip
import random

import pytest
from rows import key, library_ids, plain, spaced
from test_text_operators import brute_counts, brute_groups, brute_hits, edited, prose

from leafquarry.llm import quality, warc

PAGES = "page_id long, url string, html string, ordinal int, file string"


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://x.example/{i}", f"<p>é {i}\r\n\r\n</p>\n" * (i % 7), 1, "f") for i in range(57)]
    rows += [(None, None, None, 1, "f"), (3, "http://again", "x", 1, "f"), (3, "http://again", "x", 1, "f"), (90, None, "y", 1, "f")]
    return spark.createDataFrame(rows, PAGES)


def test_warc_round_trip(spark, pages, tmp_path):
    path = warc.write_warc(warc.with_file(pages, 20), str(tmp_path / "w"))["one"]
    got = warc.read_warc(spark, path).collect()
    assert len(got) == pages.count()
    files = {}
    for f in (tmp_path / "w").rglob("*.gz"):
        files[f.parent.name.removeprefix("file=")] = gzip.decompress(f.read_bytes())
    for r in got:
        rec = files[r.file][r.offset : r.offset + r.length]
        assert rec.startswith(b"WARC/1.0\r\n") and rec.endswith(b"\r\n\r\n") and r.record_id.encode() in rec
    assert sum(r.length for r in got) == sum(map(len, files.values()))


def test_a_crowded_block_of_ids_is_dealt_out(spark, tmp_path):
    crowd = spark.range(90).selectExpr("5L as page_id", "concat('u', id) as url", "'h' as html")
    assert warc.with_file(crowd, 20).select("file").distinct().count() > 1
    equal = spark.range(3000).selectExpr("5L as page_id", "'u' as url", "repeat('h', 100) as html")
    counts = [r["count"] for r in warc.with_file(equal, 500).groupBy("file").count().collect()]
    assert sum(counts) == 3000 and len(counts) == 6 and max(counts) < 700
    by_bytes = [r["count"] for r in warc.with_file(equal, 5000, 100_000).groupBy("file").count().collect()]
    assert len(by_bytes) == 10 and max(by_bytes) < 450


@pytest.mark.parametrize("bad", [[], [0], [3, 19, 56], list(range(40))])
def test_audit_finds_what_differs(spark, pages, tmp_path, bad):
    from pyspark.sql import functions as F

    filed = warc.with_file(pages.filter("page_id < 57 and url not like '%again'"), 20)
    hurt = F.when(F.col("page_id").isin(bad), F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    paths = warc.write_warc(filed, str(tmp_path / "a"), {"one": F.col("html"), "two": hurt})
    found = {(r.file, r.ordinal) for r in warc.audit(*(warc.read_warc(spark, p) for p in paths.values())).collect()}
    want = {(f"{i // 20}_0", i % 20) for i in bad if i % 7}
    longer = {i for i in bad if i % 7 == 0}  # an empty page that became one byte moves what follows
    assert want <= found and (longer or found == want)


def test_damaged_files_are_reported(spark, tmp_path):
    """Bytes of written files are hurt: the audit names what they held, and the rest of the replica is whole."""
    import shutil

    from pyspark.sql import functions as F

    rows = [(i, f"http://x.example/{i}", "<p>" + "".join(random.Random(i).choices("abcdefgh \n", k=400)) + "</p>") for i in range(100)]
    filed = warc.with_file(spark.createDataFrame(rows, "page_id long, url string, html string"), 20)
    paths = warc.write_warc(filed, str(tmp_path / "w"), {"one": F.col("html"), "two": F.col("html")})
    shutil.rmtree(tmp_path / "w/replica=two/file=4_0")  # a lost file
    part = lambda k: next((tmp_path / f"w/replica=two/file={k}_0").glob("*.gz"))
    plain = gzip.decompress(part(0).read_bytes())
    at = plain.index(b"Content-Length: 407", plain.index(b"<urn:page:7>"))
    part(0).write_bytes(gzip.compress(plain[:at] + b"Content-Length: 497" + plain[at + 19 :]))  # a wrong length
    raw = bytearray(part(1).read_bytes())
    raw[len(raw) // 2] ^= 255  # a flipped byte
    part(1).write_bytes(raw)
    part(2).write_bytes(part(2).read_bytes()[:-300])  # a cut file
    for f in (tmp_path / "w").rglob("*.crc"):
        f.unlink()
    one, two = (warc.read_warc(spark, p) for p in paths.values())
    found: dict = {}
    for r in warc.audit(one, two).collect():
        found.setdefault(r.file, set()).add(r.ordinal)
    assert found.pop("0_0") == {7} and found.pop("4_0") == set(range(20))
    assert 19 in found["1_0"] and 0 not in found.pop("1_0") and 19 in found["2_0"] and 0 not in found.pop("2_0") and not found
    assert {r.file for r in two.filter("error is not null").collect()} == {"0_0", "1_0", "2_0"}
    assert one.filter("error is not null").isEmpty()


def test_unpack_reads_members():
    raw = gzip.compress(b"ab" * 5000) + gzip.compress(b"cd")
    assert warc.unpack(raw) == (b"ab" * 5000 + b"cd", None) and warc.unpack(b"")[1] and warc.unpack(b"no gzip")[1]


def test_audit_of_a_lacking_record(spark, pages, tmp_path):
    one = warc.read_warc(spark, warc.write_warc(warc.with_file(pages, 20), str(tmp_path / "a"))["one"])
    last = one.filter("file = '2_0'").agg({"ordinal": "max"}).first()[0]
    two = one.filter(f"not (file = '2_0' and ordinal = {last})")
    assert [(r.file, r.ordinal) for r in warc.audit(one, two).collect()] == [("2_0", last)]


def test_audit_empty(spark, pages, tmp_path):
    none = warc.read_warc(spark, warc.write_warc(warc.with_file(pages.limit(1), 20), str(tmp_path / "a"))["one"]).limit(0)
    assert warc.audit(none, none).collect() == []


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(21)
    item = prose(14, r)
    passage = prose(70, r)
    docs = []
    for i in range(30):
        docs.append((i, prose(120, r)))
    base = prose(150, r).split()
    docs += [(100 + k, edited(base, 2, r)) for k in range(5)]
    docs += [(200, docs[0][1]), (201, docs[0][1])]
    docs += [(300 + k, prose(60, r) + " " + passage + " " + prose(60, r)) for k in range(4)]
    docs += [(400, prose(60, r) + " " + item + " " + prose(10, r)), (401, "short"), (402, None), (403, "lo la " * 60)]
    full = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [(d, t) for d, t in docs if (c := brute_counts(t))[0] >= quality.MIN_WORDS and 100 * c[4] <= 50 * c[0]]
    groups = brute_groups(left)
    best = {}
    for (d, t), g in zip(left, groups, strict=True):
        best[g] = min(best.get(g, (d, t)), (d, t), key=lambda x: key(x[0]))
    left = sorted(best.values())
    firsts = {}
    for d, t in left:
        w = spaced(t)
        for i in range(len(w) - 49):
            firsts[tuple(w[i : i + 50])] = min(firsts.get(tuple(w[i : i + 50]), d), d)
    cut = []
    for d, t in left:
        w, gone = spaced(t), set()
        for i in range(len(w) - 49):
            if firsts[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        cut.append((d, t if not gone else " ".join(x for i, x in enumerate(w) if i not in gone)))
    clean = [(d, t) for d, t in cut if not brute_hits(plain(t), [("0", plain(item))])[0]]
    assert len(clean) < len(cut) < len(docs)
    want = {d: len(library_ids(t)) for d, t in clean}
    have = {}
    for p in got:
        have[p.doc_id] = have.get(p.doc_id, 0) + p.length
    assert have == want


def test_pipeline_edges(spark, tmp_path):
    """An empty table; repeated rows, nulls in every column and extra columns with names of the operators."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(22)
    text = prose(80, r)
    rows = [(1, text, None, None, None, 5, "k"), (1, text, None, None, None, 5, "k"), (None, None, None, None, None, None, None), (None, prose(70, r), "en", "s", 1, 2, None), (3, "", "en", "s", 0, 1, "z")]
    for name, some in (("full", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long, uid long, kept string").coalesce(1).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        got = {(p.doc_id, p.start, p.length) for p in corpus_pipeline.run(spark, str(d)).collect()}
        assert got == {(r[0], 0, len(library_ids(r[1]))) for r in (rows[0], rows[3]) if some}


def test_stages_keep_the_columns():
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
