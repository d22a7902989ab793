import zlib
from collections import defaultdict

import numpy as np
import pytest
from rows import EDGE, library_ids
from hypothesis import given, settings
from hypothesis import strategies as st

from leafquarry.llm import packing, token_files, tokens


@given(st.lists(st.integers(1, 1024), max_size=200))
@settings(max_examples=60, deadline=None)
def test_best_fit_is_a_packing_near_the_bound(lengths):
    bins, offsets, fills = packing.best_fit(np.array(lengths, np.int64))
    seen = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        seen[b].append((o, n))
    for b, parts in seen.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == fills[b] <= 1024
    if lengths:
        assert len(fills) <= 11 / 9 * -(-sum(lengths) // 1024) * 1.5 + 1


@given(st.integers(0, 5000))
def test_cut_lengths(n):
    parts = packing.cut_lengths(n)
    assert sum(parts) == n and all(p == 1024 for p in parts[1:]) and all(0 < p <= 1024 for p in parts)


ODD = ["x <|endoftext|> y. z", "a.\nb c\td", "l'a, \u00a0b \u3000 c\u1680 d\u0085 e\u2009 f", "é. à b\nç", "I.e., U.S.A.: 95.77.253.173 x", "\r\n a\x0b b\x0cc\n", ".a", " .a !!b", "\n", "a\n", " a ", "", " ", "  a", "a  b", "a \n b", " x  y z\x1c w", "<|endoftext|> a", "don't 've", "trail ", "日本 語", "x \x85y", "a" * 3000, " " * 2000]


def encoded(e, texts):
    ids, at = e.encode(texts)
    return [ids[lo:hi].tolist() for lo, hi in zip(at, at[1:], strict=False)]


@given(st.lists(st.one_of(st.sampled_from(ODD), st.none(), st.text(max_size=60), st.text(alphabet=" \n\tab'.,!?;1é\x85\u00a0\u2003à日", max_size=80)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pieces_have_the_ids_of_the_whole_text(texts):
    assert encoded(tokens.encoder(), texts) == [library_ids(t) for t in texts]


def test_odd_texts_together():
    assert encoded(tokens.encoder(), ODD) == [library_ids(t) for t in ODD]


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_give_the_same_cuts(block, monkeypatch):
    data = np.frombuffer(" ".join(ODD).encode(), np.uint8)
    want = tokens.cuts(data)
    monkeypatch.setattr(tokens, "BLOCK", block)
    assert (tokens.cuts(data) == want).all()


@pytest.mark.parametrize("most", [0, 400])
def test_small_cache_gives_the_same_ids(most, monkeypatch):
    monkeypatch.setattr(tokens, "BYTES", 30)
    e = tokens.Encoder(tokens.vocabulary(), cache_bytes=most)
    texts = ["some words of a text", "other words of it", "some more words", None, "a <|endoftext|> b", "words, words. and"]
    for _ in range(3):
        assert encoded(e, texts) == [library_ids(t) for t in texts]


def test_other_vocabularies_are_encoded_whole():
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    plain, e = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["Some Words,  of a <|endoftext|> text.", "", "x\ny"]
    assert not e.cuttable and encoded(e, texts) == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def check_pieces(rows, expected):
    """Every document's ids are there once, in gapless sequences of at most 1024 ids."""
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for doc, text in expected:
        ids, start = np.array(library_ids(text), "<u4"), 0
        for k, n in enumerate(packing.cut_lengths(len(ids))):
            want.append((doc is not None, doc or 0, k, start, n, zlib.crc32(ids[start : start + n])))
            start += n
    assert got == sorted(want)
    return len(by_seq)


def test_pack_edges(edge):
    check_pieces(packing.pack(edge).collect(), EDGE)


@pytest.mark.parametrize("group", [3, 1000])
def test_pack_tree_rounds(frame, group):
    rows = [(i, "some words " * (40 * (i % 9) + 1)) for i in range(60)]
    df = frame(rows).repartition(8, "doc_id")
    n = check_pieces(packing.pack(df, group=group).collect(), rows)
    total = sum(len(library_ids(t)) for _, t in rows)
    assert n <= -(-total // 1024) + (12 if group == 3 else 3)


def test_pack_empty(empty):
    assert packing.pack(empty).collect() == []


def test_token_files_round_trip(spark, edge, tmp_path):
    path = token_files.write_token_files(edge, str(tmp_path / "files"))
    got = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    order = sorted(EDGE, key=lambda r: (r[0] is None, r[0] or 0))
    start = 0
    assert [r.doc_id for r in got] == [d for d, _ in order]
    for r, (_, text) in zip(got, order, strict=True):
        ids = library_ids(text)
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)


def test_token_files_have_an_index_and_a_dictionary(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 4)
    df = frame([(i, f"text number {i} of many with words") for i in range(40)])
    path = token_files.write_token_files(df, str(tmp_path / "files"))
    shards = spark.read.parquet(f"{path}/shards").collect()
    assert sum(len(s.known) for s in shards) == 40
    for s in shards:
        offsets = np.frombuffer(s.offsets, "<u8")
        assert offsets[0] == 0 and offsets[-1] == len(s.data) and len(offsets) == len(s.known) + 1
    spark.createDataFrame([("0" * 64, bytearray(b"no"), "trained", 2)], "dict_sha256 string, dictionary binary, kind string, width int").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="own hash"):
        token_files.read_token_files(spark, path)


def test_token_files_need_the_ids_that_were_written(spark, frame, tmp_path):
    from pyspark.sql import functions as F

    path = token_files.write_token_files(frame([(i, f"text {i}") for i in range(9)]), str(tmp_path / "files"))
    known = spark.read.parquet(f"{path}/dictionary").first()
    assert known.kind in ("trained", "content") and known.width == 2
    spark.read.parquet(f"{path}/shards").withColumn("crcs", F.unhex(F.repeat(F.lit("00"), 36))).coalesce(1).write.parquet(f"{path}/other")
    (tmp_path / "files/shards").rename(tmp_path / "files/old")
    (tmp_path / "files/other").rename(tmp_path / "files/shards")
    with pytest.raises(Exception, match="written with"):
        token_files.read_token_files(spark, path).collect()


def test_a_trained_dictionary_serves_long_and_short_documents(spark, frame, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"word{k}" for k in r.integers(0, 200, int(r.integers(1, 600))))) for i in range(200)]
    path = token_files.write_token_files(frame(rows), str(tmp_path / "files"))
    assert spark.read.parquet(f"{path}/dictionary").first().kind == "trained"
    got = token_files.read_token_files(spark, path, with_ids=True).collect()
    assert {x.doc_id: x.ids for x in got} == {d: library_ids(t) for d, t in rows}


def test_token_files_empty(spark, empty, tmp_path):
    path = token_files.write_token_files(empty, str(tmp_path / "files"))
    assert token_files.read_token_files(spark, path).collect() == []
