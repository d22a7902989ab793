"""The functions of jvm/Codecs.java against the Python modules that they follow."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafquarry.codec import bzz, iw44, jb2
from leafquarry.formats import build, iff, payloads
from leafquarry.functions import jvm
from leafquarry.operators import container, images, render, text_layer
from leafquarry.plans import layout
from leafquarry.raster import bitmaps, page
from leafquarry.sources import containers

TEXTS = ["", "one", " \t\n", "é日 " * 330, "word x   " * 90, "".join(random.Random(3).choices("ab \n", k=9000)), "x" * 5000 + " y", None]


def binary(spark, values):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in enumerate(values)], "doc_id long, p binary")


def documents(spark):
    return spark.createDataFrame([(k, t, [None, "en"][k % 2], "s") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")


def test_bzz_has_the_same_bytes_and_refuses_the_same(spark):
    r = random.Random(1)
    values = [b"", b"a", b"ab" * 700, r.randbytes(3000), bytes(250_000), "wörter ".encode() * 20_000]
    df = binary(spark, values)
    packed = [bytes(x.e) for x in df.select("doc_id", jvm.call(df, "BzzEncode", "binary", F.col("p")).alias("e")).orderBy("doc_id").collect()]
    assert packed == [bzz.encode(v) for v in values]
    back = binary(spark, packed)
    assert [bytes(x.d) for x in back.select("doc_id", jvm.call(back, "BzzDecode", "binary", F.col("p")).alias("d")).orderBy("doc_id").collect()] == values
    bad = binary(spark, [b"\0" * 40])
    with pytest.raises(Exception, match="(too large|no end mark|corrupt|ends early)"):
        bad.select(jvm.call(bad, "BzzDecode", "binary", F.col("p"))).collect()


@pytest.mark.parametrize("layer", ["TXTa", "TXTz"])
def test_made_files_have_the_same_bytes(spark, layer):
    got = {r.doc_id: bytes(r.content) for r in layout.containers(documents(spark), layer).collect()}
    for k, t in enumerate(TEXTS):
        ws = [w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        n = -(-len(ws) // 320)
        marks = None if k % 3 == 0 or not n else [("Start", "#1", [("Last", str(n), []), ("Nowhere", f"#{n + 1}", [])])]
        assert got[k] == build.document(ws, marks, f'(metadata (lang "{[None, "en"][k % 2]}") (source s))', n // 2, layer), k


def test_walks_are_the_same_with_page_numbers(spark):
    good = build.document([f"w{i}" for i in range(700)], [("A", "#1", [])], "(n 1)", 2)
    single = iff.container(iff.form("DJVU", [iff.chunk("INFO", payloads.info(3, 4)), iff.chunk("Zz'z", b"abc"), iff.chunk("Sjbz", b"")]))
    bad = [b"", good[:-1], good[:200], b"AT&TFORM\0\0\0\x0cDJVUIN'\n\0\0\0\x09", b"AT&TFORM\0\0\0\x08XXXXABCD"]
    rows = containers.walk(binary(spark, [good, single, *bad]).withColumnRenamed("p", "content")).orderBy("doc_id", "node_id").collect()
    for k, data in enumerate([good, single, *bad]):
        mine = [r for r in rows if r.doc_id == k]
        try:
            nodes = iff.walk(data)
        except iff.Corrupt as e:
            assert [r.error for r in mine] == [str(e)]
            continue
        assert [(r.node_id, r.parent_id, r.ord, r.depth, r.subtree_end, r.form_type, r.chunk_id, r.chunk_type, r.node_offset, r.data_offset, r.length) for r in mine] == [
            (n.node_id, n.parent_id, n.ord, n.depth, n.subtree_end, n.form_type, n.chunk_id, n.chunk_type, n.node_offset, n.data_offset, n.length) for n in nodes]
        assert all(r.payload is None if r.form_type else bytes(r.payload) == data[r.data_offset : r.data_offset + r.length] for r in mine)
    assert [r.page_no for r in rows if r.doc_id == 0 and r.chunk_type in ("DJVU", "INFO", "DJVM", "ANTA")] == [None, None, 1, 1, 2, 2, 3, 3]
    assert {r.page_no for r in rows if r.doc_id == 1} == {1}


def test_layers_and_rolled_texts(spark):
    Z = payloads.Zone
    deep = Z("Page", 0, 0, 900, 900, 0, 9, [Z("Region", 10, 500, 200, 300, 0, 4, [Z("Word", 12, 600, 5, 5, 0, 3, [Z("Character", 12, 600, 5, 5, 0, 1)])]), Z("Line", 0, 300, 50, 50, 4, 3, [Z("Word", 0, 300, 5, 5, 4, 1), Z("Word", 9, 300, 5, 5, 5, 9)]), Z("Line", 0, 200, 9, 9, 2, 2), Z("Paragraph", 0, 100, 9, 9, 1, 3)])
    raw = [payloads.text_layer("äbc defg", deep), payloads.text_layer("only", None), payloads.text_layer("x", Z("Page", 0, 0, 9, 9, -1, 2)), b"\0\0\x05ab", payloads.text_layer("abc", deep)[:-3]]
    df = binary(spark, raw).select("doc_id", F.lit(1).alias("page_no"), F.lit("TXTA").alias("chunk_type"), F.col("p").alias("payload"))
    got = text_layer.decode(df)
    for r in got.collect():
        try:
            text, version, zones = payloads.read_text_layer(raw[r.doc_id])
        except ValueError as e:
            assert (r.error, r.text, r.zones) == (str(e), None, [])
            continue
        assert (r.text, r.version, r.error) == (text, version, None) and [z.asDict() for z in r.zones] == zones
    key = lambda x: (x.doc_id, x.zone_id)
    whole = sorted(text_layer.rollup(text_layer.zones(got)).collect(), key=key)
    assert sorted(text_layer.rolled_layers(df).collect(), key=key) == whole and len(whole) == 10


def test_directories_bookmarks_and_palettes(spark):
    entries = [{"offset": 7, "size": 5, "kind": "page", "id": "a﻿", "name": "n", "title": "t"}, {"offset": 9, "size": 70_000, "kind": "shared", "id": "é"}]
    df = binary(spark, [payloads.dirm(entries), payloads.dirm(entries, False, 2)]).selectExpr("doc_id", "p as payload", "'DIRM' as chunk_type")
    for r in container.components(df).collect():
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == payloads.read_dirm(payloads.dirm(entries, r.doc_id == 0, 1 + r.doc_id))[r.ord]
    from leafquarry.operators import navigation

    marks = [("A", "1", [("B", "#3", [("é", "", [])]), ("C", "x", [])]), ("D", "#9", [])]
    df = binary(spark, [payloads.navm(marks)]).selectExpr("doc_id", "p as payload", "'NAVM' as chunk_type")
    got = [{k: v for k, v in r.asDict().items() if k not in ("doc_id", "n_below")} for r in navigation.bookmarks(df).orderBy("bm_id").collect()]
    assert got == payloads.read_navm(payloads.navm(marks))


def glyph(seed, w, h):
    return (np.random.default_rng(seed).random((h, w)) > 0.4).astype(np.uint8)


def masks():
    a, b, d = glyph(1, 9, 12), glyph(2, 14, 7), glyph(3, 20, 20)
    shared = jb2.encode(0, 0, [(jb2.MARK_LIBRARY, d, None, 0), (jb2.REFINE_LIBRARY, np.roll(d, 1, 0), None, 0)])
    records = [(jb2.MARK, a, (5, 80), 0), (jb2.MARK_IMAGE, b, (20, 81), 0), (jb2.COPY, None, (40, 79), 0), (jb2.REFINE, np.roll(a, 1, 1), (-3, 50), 2), (jb2.COPY, None, (33, 51), 2), (jb2.NON_MARK, b, (60, 0), 0), (jb2.DICT_OR_RESET, None, None, 0), (jb2.REFINE_IMAGE, a, (95, 20), 1), (jb2.REFINE_LIBRARY, a, None, 0)]
    return shared, jb2.encode(100, 98, records, jb2.decode(shared).shapes, "note é")


def test_masks(spark):
    shared, mask = masks()
    rows = [(0, bytearray(mask), bytearray(shared)), (1, bytearray(mask), None), (2, bytearray(b"\xff" * 9), None)]
    df = spark.createDataFrame(rows, "doc_id long, SJBZ binary, DJBZ binary")
    image = jb2.decode(mask, jb2.decode(shared))
    got = df.select("doc_id", images.parts(df).alias("m")).orderBy("doc_id").collect()
    m = got[0].m
    assert (m.width, m.height, m.comment, m.error) == (100, 98, "note é", None) and got[1].m.error and got[2].m.error
    assert [(b.shape_no, b.left, b.bottom) for b in m.blits] == image.blits
    assert [(s.parent_shape, s.inherited, bytes(s.data)) for s in m.shapes] == [(s.parent, k < 2, s.bits.tobytes()) for k, s in enumerate([*image.inherited, *image.shapes])]
    one = df.filter("doc_id = 0")
    for sub in (1, 3):
        level = one.select(images.levels(one, F.lit(None).cast("binary"), sub).alias("v")).first().v
        assert bytes(level.inks[0].data) == jb2.compose(image, sub).tobytes()
    ink, full = one.select(images.ink(one).alias("i")).first().i, (jb2.compose(image) > 0)
    assert tuple(ink) == (int(full.sum()), len(image.blits), *bitmaps.ink_box(full))


def test_wavelets(spark):
    y, x = np.mgrid[0:50, 0:70]
    g = ((np.sin(y / 7) + np.cos(x / 9)) * 60 + 128).astype(np.uint8)
    df = spark.createDataFrame([(bytearray(g.tobytes()), 70, 50)], "m binary, w int, h int")
    gray = [bytes(c) for c in df.select(jvm.call(df, "WaveletGray", "array<binary>", F.col("m"), F.col("w"), F.col("h"), F.array(F.lit(60), F.lit(30))).alias("c")).first().c]
    assert gray == iw44.encode(g, (60, 30))
    color = iw44.encode(np.stack([g, 255 - g, g // 2], -1), (60, 30, 20))
    df = spark.createDataFrame([([bytearray(c) for c in chunks],) for chunks in (gray, color, color[1:])], "c array<binary>").repartition(1)
    for sub, size in ((1, (70, 50)), (4, (140, 100))):  # the page is twice as large: at 1/4 the image is read at 1/2
        w, h = (F.lit(v) for v in size)
        got = [r.v for r in df.select(images.wavelet(df, F.col("c"), w, h, sub).alias("v")).collect()]
        for chunks in (gray, color):
            m = iw44.decode(chunks, {1: 1, 4: 2}[sub])
            assert any(v.data is not None and bytes(v.data) == m.tobytes() and (v.height, v.width) == m.shape[:2] and (v.full_width, v.full_height) == (70, 50) for v in got)
        assert [v.error for v in got if v.error] == ["chunk 1 comes where 0 is due"]


@pytest.mark.parametrize("layer", ["page", "mask", "background", "thumbnail"])
def test_rendering_equals_the_picture_of_the_bytes(spark, layer):
    shared, mask = masks()
    n = len(jb2.decode(mask, jb2.decode(shared)).blits)
    bg, fg = iw44.encode(np.full((49, 50, 3), 200, np.uint8), (60,)), iw44.encode(np.full((9, 10, 3), 30, np.uint8), (60,))
    colors = payloads.palette([(1, 2, 3), (90, 80, 70)], [k % 2 for k in range(n - 1)])
    pages = [(bg, [], None), (bg, [], colors), (bg, fg, None), ([], [], colors), ([], [], None)]
    rows = []
    for k, (b, f, p) in enumerate(pages):
        parts = [("INFO", payloads.info(100, 98)), ("SJBZ", mask), ("DJBZ", shared), *[("BG44", c) for c in b], *[("FG44", c) for c in f], *([("FGBZ", p)] if p else [])]
        rows += [(k, 1, kind, i, bytearray(v)) for i, (kind, v) in enumerate(parts)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, kind string, ord int, payload binary")
    for sub in (1, 2, 3):
        for r in render.render(df, sub, layer=layer).collect():
            b, f, p = pages[r.doc_id]
            x = page.Layers(100, 98, 2.2, mask, shared, b, f, p)
            want = {"page": lambda: page.picture(x, sub), "mask": lambda: page.mask(x, sub)[0], "background": lambda: page.background(x, sub), "thumbnail": lambda: page.thumbnail(x)}[layer]()
            assert r.error is None and bytes(r.data) == want.tobytes(), (r.doc_id, sub)
