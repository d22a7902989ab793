"""What operators 9 and 10 move between tasks, and the tables that keep rows out of it."""

import random

import numpy as np
import pytest
from rows import key

from leafquarry.llm import common, near, substrings


@pytest.fixture
def moved(spark):
    """Bytes of shuffles that were written by then, with no table small enough to be broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def blobs(n, words, r):
    """Texts of few words that no other has, and much that is no word and does not compress."""
    marks = [chr(c) for c in range(33, 48)] + [chr(c) for c in range(58, 65)]
    return [(i, " ".join("".join(r.choices(marks, k=400)) + f" w{i}x{j}" for j in range(words))) for i in range(n)]


def test_near_moves_few_texts(frame, moved):
    docs = blobs(100, 60, random.Random(1))
    docs += [(1000 + i, t) for i, t in docs[:3]] + [(2000, docs[5][1] + " more")]
    size = sum(len(t) for _, t in docs)
    df, start = frame(docs), moved()
    got = {r.doc_id: r.class_id for r in near.report(df).collect()}
    assert {d: c for d, c in got.items() if d != c} == {1000: 0, 1001: 1, 1002: 2, 2000: 5}
    assert moved() - start < 0.4 * size
    start = moved()
    kept = near.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100))
    assert moved() - start < 0.4 * size


def test_substrings_move_few_texts(frame, moved):
    docs = [(i, " ".join(f"w{i}x{j}" + "".join(random.Random(i * 1000 + j).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60)) for j in range(120))) for i in range(100)]
    passage = " ".join(docs[7][1].split()[10:70])
    docs += [(1000, docs[3][1]), (1001, f"start {passage} end"), (1002, passage), (1003, None), (1004, "")]
    size = sum(len(t or "") for _, t in docs)
    df, start = frame(docs), moved()
    got = {r.doc_id: r.text for r in substrings.remove(df).collect()}
    assert got == {d: t for d, t in docs if d not in (1000, 1002)} | {1001: "start end"}
    assert moved() - start < 0.4 * size


@pytest.mark.parametrize("words", [1 << 20, 1])
def test_among_and_without(spark, monkeypatch, words):
    monkeypatch.setattr(common, "MARK_WORDS", words)
    df = spark.range(-500, 500).selectExpr("id as uid", "id % 7 as x").unionByName(spark.createDataFrame([(None, 1), (3, 9)], "uid long, x long"))
    rows = [tuple(r) for r in df.collect()]
    for values in ([], [3], [3, 3, -500, 499, 10**12], list(range(-500, 500, 3))):
        v = common.cut(spark.createDataFrame([(x,) for x in values], "uid long"))
        assert sorted(map(tuple, common.among(df, v, "uid").collect())) == sorted(r for r in rows if r[0] in values)
        assert sorted(map(tuple, common.without(df, v, "uid").collect()), key=lambda r: (key(r[0]), r[1])) == sorted((r for r in rows if r[0] not in values), key=lambda r: (key(r[0]), r[1]))


def test_bit_table_holds_all_and_lets_few_others_pass(spark, monkeypatch):
    """With more hashes than bits, a table without ranges let 1 - exp(-hashes / bits) of the others pass."""
    monkeypatch.setattr(near, "FILTER_BITS", 1 << 16)
    r = np.random.default_rng(1)
    sets = [np.sort(r.integers(0, 2**64, n, np.uint64, endpoint=False)) for n in r.integers(30, 2000, 4000)]
    low = [s[: near.SAMPLE] for s in sets]
    table = near._bit_table(spark.createDataFrame([(common.signed(h).tolist(),) for h in low], "low array<long>"))
    assert table.size.sum() <= 1.1 * (1 << 16)
    assert all(table.has(h).all() for h in low)
    passed = table.has(r.integers(0, 2**64, 100_000, np.uint64, endpoint=False)).mean()
    assert passed < 0.3 < 1 - np.exp(-sum(map(len, low)) / (1 << 16))
    assert not near.BitTable(np.zeros(near.RANGES, np.int64)).empty().any()


def test_held_texts_do_not_depend_on_the_bit_table(frame, monkeypatch):
    r = random.Random(3)
    words = [f"k{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(5, 200))) for _ in range(40)]
    docs = list(enumerate(texts + [" ".join(t.split()[: r.randint(5, 60)]) for t in texts] + ["", None]))
    df = frame(docs)
    want = sorted(map(tuple, near.report(df).collect()))
    assert sum(x[4] > 0 for x in want) > 20
    monkeypatch.setattr(near, "FILTER_BITS", 1 << 10)
    assert sorted(map(tuple, near.report(df).collect())) == want
