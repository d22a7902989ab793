"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A block is a line of a text, or a window of as many consecutive words as the template has, over line ends; it meets
a template if it holds THRESHOLD of the template's distinct words. Windows are compared only in texts that
hold so many words of the template at all. The templates are a stated query set, searched in all rows. Their words are ordered by how many documents
have them, rarest first, so that a line that meets template T shares one of T's first |T| - need + 1 words
(prefix filter). Of the lines that do, those with fewer template words than needed go (length filter),
then those in which the words after the first common one, in that order, are too few on either side
(positional filter), and the rest are compared exactly. The filters decide what is compared, never the result.

Everything is local to a row: no shuffle but the counts of template words.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are reported
each; an empty table gives no row; extra columns are ignored. The score is 1 where a phrase of PHRASES
stands, else the largest share of a template that a block holds, if that meets the threshold, else 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import common

THRESHOLD = 0.9
#: Words that must stand one after the other, and their label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Templates as words, with their label. A label may have several.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def plain(text: Column) -> Column:
    """The words of a lower-cased text, each between two spaces; one space for none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(text, F.lit(" ")), _BREAKS, " ")))


def words_of(padded: Column) -> Column:
    return F.filter(F.split(padded, " "), lambda w: w != "")


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _any_word(words: list[str]) -> str:
    return " (?:" + "|".join(sorted(words)) + ") "


def need(template: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(template) - 1e-9)


def order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by how many documents hold each word, rarest first, then by the alphabet."""
    held = docs.select(plain(lowered(F.col("text"))).alias("p")).filter(F.col("p").rlike(_any_word(vocabulary))).select(F.explode(F.array_intersect(_array(vocabulary), F.split("p", " "))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each word of the templates at most
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document; `blocks` has the lines that meet a template, as struct(line, label, share), `windows` the windows, as struct(word, label, share)."""
    split = [(sorted(set(words.split())), label) for words, label in templates]
    lengths = [len(words.split()) for words, _ in templates]
    docs = common.pick(docs, "doc_id", "text")
    rank = {w: k for k, w in enumerate(order(docs, sorted({w for t, _ in split for w in t})))}
    split = [(sorted(t, key=rank.__getitem__), label) for t, label in split]
    vocabulary = sorted(rank, key=rank.__getitem__)
    prefix = sorted({w for t, _ in split for w in t[: len(t) - need(t, threshold) + 1]})
    fewest = min(need(t, threshold) for t, _ in split)

    base = docs.select("doc_id", lowered(F.col("text")).alias("low")).select("doc_id", "low", plain(F.col("low")).alias("p"))
    base = base.withColumn("n_words", (F.length("p") - F.length(F.replace("p", F.lit(" "), F.lit(""))) - 1).cast("long"))
    some = reduce(lambda a, b: a | b, [F.contains("p", F.lit(f" {words} ")) for words, _ in phrases])
    base = base.withColumn("w", F.when(some, words_of(F.col("p"))).otherwise(_array([])))

    def places(words: str) -> Column:
        parts = words.split()
        here = lambda i: reduce(lambda a, b: a & b, [F.get("w", i + k) == p for k, p in enumerate(parts)])
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - len(parts), F.lit(0))), lambda i: F.coalesce(here(i), F.lit(False)))

    base = base.withColumns({f"at{k}": F.when(F.contains("p", F.lit(f" {words} ")), places(words)).otherwise(F.array().cast("array<int>")) for k, (words, _) in enumerate(phrases)})
    # prefix and length filter of the blocks: (line, its template words in the global order)
    lines = F.transform(F.split("low", "\n"), lambda line, i: F.struct(i.alias("line"), F.array_intersect(_array(vocabulary), F.split(plain(line), " ")).alias("t")))
    lines = F.filter(lines, lambda b: (F.size(b.t) >= fewest) & F.arrays_overlap(b.t, _array(prefix)))
    nothing = F.array().cast("array<struct<line:int,t:array<string>>>")
    base = base.withColumn("b", F.when(F.col("p").rlike(_any_word(prefix)), lines).otherwise(nothing))

    def meets(words: list[str], label: str) -> Column:
        alpha, t = need(words, threshold), _array(words)

        def share(b: Column) -> Column:
            common_words = F.array_intersect(t, b.t)
            first = F.get(common_words, F.lit(0))
            left = F.least(F.lit(len(words)) - F.array_position(t, first), F.size(b.t) - F.array_position(b.t, first)) + 1
            ok = (F.size(b.t) >= alpha) & F.arrays_overlap(_array(words[: len(words) - alpha + 1]), b.t) & (left >= alpha) & (F.size(common_words) >= alpha)
            return F.struct(b.line.alias("line"), F.lit(label).alias("label"), F.when(ok, F.size(common_words) / F.lit(float(len(words)))).alias("share"))

        return F.filter(F.transform("b", share), lambda x: x.share.isNotNull())

    base = base.withColumn("blocks", F.when(F.size("b") > 0, F.concat(*[meets(t, label) for t, label in split])).otherwise(F.array().cast("array<struct<line:int,label:string,share:double>>")))
    # windows: word positions from which a template's length of words holds enough of it
    base = base.withColumn("held", F.when(F.col("p").rlike(_any_word(prefix)), F.array_intersect(_array(vocabulary), F.split("p", " "))).otherwise(_array([])))
    enough = lambda words: F.size(F.array_intersect(_array(words), F.col("held"))) >= need(words, threshold)
    base = base.withColumn("v", F.when(reduce(lambda a, b: a | b, [enough(t) for t, _ in split]), words_of(F.col("p"))).otherwise(_array([])))

    def stretches(words: list[str], label: str, length: int) -> Column:
        alpha, t = need(words, threshold), _array(words)
        n = lambda i: F.size(F.array_intersect(t, F.slice(F.col("v"), i + 1, F.lit(length))))
        counted = F.transform(F.sequence(F.lit(0), F.greatest(F.size("v") - length, F.lit(0))), lambda i: F.struct(i.alias("word"), n(i).alias("n")))
        met = F.transform(F.filter(counted, lambda x: x.n >= alpha), lambda x: F.struct(x.word.alias("word"), F.lit(label).alias("label"), (x.n / F.lit(float(len(words)))).alias("share")))
        return F.when(enough(words), met).otherwise(F.array().cast("array<struct<word:int,label:string,share:double>>"))

    base = base.withColumn("windows", F.when(F.size("v") > 0, F.concat(*[stretches(t, label, n) for (t, label), n in zip(split, lengths, strict=True)])).otherwise(F.array().cast("array<struct<word:int,label:string,share:double>>")))
    every = F.concat(*[F.col(f"at{k}") for k in range(len(phrases))])
    own = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    out = base.select("doc_id", "n_words", "blocks", "windows", every.alias("every"), own.alias("own"))
    return out.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", F.transform("blocks", lambda x: x.label), F.transform("windows", lambda x: x.label)))), ",").alias("labels"),
        F.when(F.size("own") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.concat(F.transform("blocks", lambda x: x.share), F.transform("windows", lambda x: x.share))), F.lit(0.0))).alias("score"),
        "blocks", "windows",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("blocks", "windows")


def _oracle() -> str:
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    tokens = lambda x: rf"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    at = ", ".join(
        f"list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(words.split())) + f") AS at{n}"
        for n, (words, _) in enumerate(PHRASES)
    )
    hits = ", ".join(f"CASE WHEN len(at{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(PHRASES))
    rows = ", ".join(f"({sorted(set(words.split()))!r}, '{label}')" for words, label in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {low} AS low FROM documents),
w AS (SELECT rid, doc_id, {tokens('low')} AS w FROM d),
a AS (SELECT rid, doc_id, len(w) AS n, {at} FROM w),
b AS (SELECT rid, doc_id, n, {' || '.join(f'at{n}' for n in range(len(PHRASES)))} AS every,
  list_filter([{hits}], lambda x: x IS NOT NULL) AS own FROM a),
t(tw, label) AS (VALUES {rows}),
l AS (SELECT rid, unnest(string_split(low, chr(10))) AS line FROM d),
m AS (SELECT rid, label, len(list_intersect(tw, toks)) / CAST(len(tw) AS DOUBLE) AS share
  FROM (SELECT rid, list_distinct({tokens('line')}) AS toks FROM l) x, t
  WHERE len(list_intersect(tw, toks)) >= {THRESHOLD} * len(tw) - 1e-9),
g AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS share FROM m GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word,
  CAST(list_max(every) AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(own || coalesce(more, []))), ','), '') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
