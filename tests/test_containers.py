import codecs

import pytest
from pyspark.sql import functions as F

from leafquarry.formats import build, iff, payloads
from leafquarry.functions import binary, geometry, register, text
from leafquarry.operators import annotations, container, navigation, render, text_layer
from leafquarry.sources import containers, writer
from leafquarry.streaming import ingest

WORDS = [f"word{i}" if i % 7 else f"é日{i}" for i in range(700)]


def file_rows(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "doc_id long, content binary")


def test_walk_and_write_back(spark):
    data = build.document(WORDS, [("A", "#1", [("B", "2", [])])], '(a "x)y")', 2)
    nodes = iff.walk(data)
    assert [n.chunk_type for n in nodes[:4]] == ["DJVM", "DIRM", "NAVM", "DJVI"] and nodes[0].subtree_end == len(nodes) - 1
    f = file_rows(spark, data)
    assert bytes(writer.assemble(containers.chunks(f)).first().content) == data


@pytest.mark.parametrize("bad", [b"", b"AT&TFORM", b"AT&TFORM\0\0\0\x08XXXXABCD", b"AT&TFORM\0\0\0\xffDJVUINFO", b"AT&TFORM\0\0\0\x0cDJVUINFO\0\0\0\x09"])
def test_broken_files_are_error_rows(spark, bad):
    rows = containers.walk(file_rows(spark, bad, build.document(WORDS[:3]))).collect()
    assert [r.doc_id for r in rows if r.error] == [0] and sum(r.doc_id == 1 for r in rows) > 5


def test_unknown_and_odd_chunks():
    data = iff.container(iff.form("DJVU", [iff.chunk("Zzzz", b"abc"), iff.chunk("info", payloads.info(3, 4))]))
    kinds = [(n.chunk_type, n.length) for n in iff.walk(data)]
    assert kinds == [("DJVU", 30), ("UNKNOWN", 3), ("INFO", 10)]


def test_info_in_catalyst_equals_python(spark):
    for rotation in ("NONE", "CCW", "180", "CW"):
        p = payloads.info(2600, 3360, 300, 2.2, rotation)
        got = spark.createDataFrame([(bytearray(p),)], "p binary").select(*[c.alias(n) for n, c in binary.info_columns(F.col("p")).items()]).first().asDict()
        code = got.pop("rotation_code")
        assert got == payloads.read_info(p) and code == ["NONE", "CCW", "180", "CW"].index(rotation)


def test_numbers(spark):
    df = spark.createDataFrame([(bytearray(bytes([0xFF, 0xFE, 0x01, 0x02, 0x80, 0, 0, 0])),)], "p binary")
    p = F.col("p")
    got = df.select(binary.unsigned(p, 0, 2), binary.signed(p, 0, 2), binary.unsigned(p, 0, 3), binary.unsigned(p, 1, 2, "little"), binary.signed(p, 4, 4), binary.biased(p, 0), binary.unsigned(p, 6, 4), binary.unsigned(p, 0, 8)).first()
    assert [int(v) if v is not None else None for v in got] == [0xFFFE, -2, 0xFFFE01, 0x01FE, -(2**31), 0x7FFE, None, 0xFFFE010280000000]


def test_marked_strings():
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF32_LE, "utf-32-le"), (b"", "utf-8")):
        assert payloads.decode_marked(mark + "né".encode(name)) == "né"


def test_text_layers(spark):
    for layer in ("TXTa", "TXTz"):
        chunks = containers.chunks(file_rows(spark, build.document(WORDS, layer=layer)))
        layers = text_layer.decode(container.page_chunks(chunks, ["TXTA", "TXTZ"])).cache()
        assert [r.text for r in layers.orderBy("page_no").collect()] == [" ".join(WORDS[k : k + 320]) for k in (0, 320, 640)]
        zones = text_layer.zones(layers)
        words = zones.filter("zone_type = 'Word'").orderBy("page_no", "zone_id").collect()
        assert [w.text for w in words] == WORDS
        assert all((w.x, w.y) == (i % 8 * 100, i // 8 % 40 * 20) for i, w in enumerate(words))
        hits = text_layer.search(zones, "WORD69").collect()
        assert {h.text for h in hits} == {w for w in WORDS if "word69" in w}
        lines = text_layer.rollup(zones).filter("zone_type = 'Line'").orderBy("page_no", "zone_id").collect()
        assert lines[0].rolled == " ".join(WORDS[:8]) + "\r\n"
        empty = text_layer.page_text(container.page_forms(chunks), layers.filter("page_no = 1")).orderBy("page_no").collect()
        assert [bool(r.text) for r in empty] == [True, False, False]


def test_zone_rules():
    """Places are told against siblings to the right or below, or the parent; a region is like a column."""
    Z = payloads.Zone
    root = Z("Page", 0, 0, 1000, 1000, 0, 9, [Z("Region", 10, 500, 200, 300, 0, 4, [Z("Character", 12, 600, 5, 5, 0, 1)]), Z("Region", 300, 400, 100, 100, 4, 2), Z("Paragraph", 0, 300, 50, 50, 6, 1), Z("Paragraph", 5, 100, 50, 50, 7, 2)])
    text_, version, zones = payloads.read_text_layer(payloads.text_layer("äbc defg", root))
    assert (text_, version) == ("äbc defg", 1)
    assert [(z["zone_type"], z["x"], z["y"], z["text_offset"]) for z in zones] == [("Page", 0, 0, 0), ("Region", 10, 500, 0), ("Character", 12, 600, 0), ("Region", 300, 400, 4), ("Paragraph", 0, 300, 6), ("Paragraph", 5, 100, 7)]
    assert zones[0]["text"] == "äbc defg" and [z["subtree_end"] for z in zones] == [5, 2, 2, 3, 4, 5]
    assert payloads.read_text_layer(payloads.text_layer("only text", None))[2] == []


def test_references(spark):
    c = containers.chunks(file_rows(spark, build.document(WORDS, [("A", "1", [("B", "#3", []), ("C", "http://x", [])]), ("D", "#9", [])], "(n 1)", 2), build.document(WORDS[:5])))
    comp = container.components(c)
    assert [(r.doc_id, r.id, r.kind) for r in comp.filter("doc_id = 0").orderBy("ord").collect()][0] == (0, "shared.iff", "include")
    pages = container.pages(c)
    named = container.page_components(pages, comp).orderBy("doc_id", "page_no").collect()
    assert [r.component_id for r in named] == ["p0001.djvu", "p0002.djvu", "p0003.djvu", "p0001.djvu"]
    assert container.resolve_includes(container.includes(c), comp, c).count() == 4
    assert [r.th44_node_id is not None for r in container.thumbnails(pages, c).orderBy("doc_id", "page_no").collect()] == [True, True, False, False]
    marks = navigation.bookmarks(c)
    targets = navigation.target_pages(marks, pages)
    assert {(r.name, r.page_no, r.n_below) for r in targets.collect()} == {("A", 1, 2), ("B", 3, 0), ("C", None, 0), ("D", None, 0)}
    assert navigation.bad_targets(targets).count() == 2
    assert [(r.name, r.url) for r in navigation.outline(pages, marks).orderBy("doc_id", "ord").collect()] == [("A", "1"), ("D", "#9"), ("Page 1", "#1")]
    assert {(r.kind, r.chunk_type) for r in container.partitions(c, comp).collect()} == {("page", "DJVU"), ("include", "DJVI"), ("thumbnail", "THUM")}
    assert [(r.previous_page, r.next_page) for r in container.neighbours(pages.filter("doc_id = 0")).orderBy("page_no").collect()] == [(1, 2), (1, 3), (2, 3)]
    assert container.descendants(c, ["TXTA"]).count() == 4 and container.descendants(c, None).count() == c.count() - 2
    assert '"DJVM"' in containers.dump(c).first().json


def test_indirect_directory():
    entries = [{"offset": 7, "size": 5, "kind": "page", "id": "a", "name": "n", "title": "t"}, {"offset": 9, "size": 70_000, "kind": "shared", "id": "b"}]
    for bundled in (True, False):
        got = payloads.read_dirm(payloads.dirm(entries, bundled))
        assert [(g["id"], g["name"], g["title"], g["kind"], g["size"], g["offset"]) for g in got] == [("a", "n", "t", "page", 5, 7 if bundled else None), ("b", None, None, "shared", 70_000, 9 if bundled else None)]


def test_palette_and_wavelet_header(spark):
    p = payloads.read_palette(payloads.palette([(1, 2, 3), (4, 5, 6)], [1, 0, 1]))
    assert p["blit_colors"] == [1, 0, 1] and p["colors"][1] == {"b": 4, "g": 5, "r": 6}
    raw = bytes([0, 74, 1, 2, 0, 70, 0, 50, 0x8A])
    got = spark.createDataFrame([(bytearray(raw),)], "p binary").select(*[c.alias(n) for n, c in binary.wavelet_columns(F.col("p")).items()]).first().asDict()
    assert got == payloads.read_wavelet_header(raw)


SAMPLES = ['(metadata (lang "en") (n 1))', "(a)(b (c (d e)))", '(t "x ) ( \\" y" z)', "", "plain"]


def test_annotations(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id long, text string")
    rows = annotations.parse(df)
    back = {r.doc_id: r.text for r in annotations.render(rows).collect()}
    assert back == {0: SAMPLES[0], 1: "(a) (b (c (d e)))", 2: SAMPLES[2]}
    assert {(r.doc_id, r.name) for r in annotations.trees(df).collect()} == {(0, "metadata"), (1, "a"), (1, "b"), (2, "t")}
    broken = annotations.parse(spark.createDataFrame([(9, "(ok 1) (open (x)")], "doc_id long, text string")).collect()
    assert [r.name for r in broken if r.name] == ["ok"] and sum(r.error is not None for r in broken) == 1


def test_geometry(spark):
    df = spark.range(1).select(geometry.rect(0, 0, 10, 10).alias("a"), geometry.rect(5, 5, 20, 8).alias("b"), geometry.rect(30, 30, 40, 40).alias("c"), geometry.rect(3, 3, 3, 9).alias("e"))
    a, b, c, e = (F.col(x) for x in "abce")
    got = df.select(geometry.intersect(a, b), geometry.hull(a, b), geometry.intersect(a, c), geometry.hull(a, e), geometry.inflate(a, 1, 2), geometry.translate(a, 3, -1), geometry.is_empty(e), geometry.contains(a, b), geometry.contains_point(a, F.lit(9), F.lit(0))).first()
    assert [tuple(x) for x in got[:6]] == [(5, 5, 10, 8), (0, 0, 20, 10), (0, 0, 0, 0), (0, 0, 10, 10), (-1, -2, 11, 12), (3, -1, 13, 9)] and list(got[6:]) == [True, False, True]


def test_trimmed_and_search_words(spark):
    df = spark.createDataFrame([("  a\t\n",), ("Straße",)], "t string")
    assert [r[0] for r in df.select(text.trimmed(F.col("t"))).collect()] == ["a", "Straße"]
    assert [r[0] for r in df.select(text.holds(F.col("t"), "")).collect()] == [True, True]


def test_scan_stream_and_sql(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.djvu").write_bytes(build.document(WORDS[:20]))
    (tmp_path / "in/b.txt").write_bytes(b"nothing")
    files = containers.scan(spark, str(tmp_path / "in"))
    assert {(r.name, r.is_container) for r in files.select("name", "is_container").collect()} == {("a.djvu", True), ("b.txt", False)}
    q = ingest.write_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("chunk_type = 'TXTA'").count() == 1 and got.filter("error is not null").count() == 1
    register.register(spark)
    assert spark.sql("select cast(bzz_decode(bzz_encode(cast('some text' as binary))) as string) t, annotation_names('(a 1)(b)') n").first() == ("some text", ["a", "b"])


def test_render_reports_broken_pages(spark):
    good = iff.container(iff.form("DJVU", [iff.chunk("INFO", payloads.info(8, 8))]))
    bad = iff.container(iff.form("DJVU", [iff.chunk("INFO", payloads.info(8, 8)), iff.chunk("Sjbz", b"\xff" * 9)]))
    out = render.render(render.page_layers(containers.chunks(file_rows(spark, good, bad))))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].error is None and len(rows[0].data) == 192 and rows[1].error
