"""Language identification by a linear-chain conditional random field over words.

Features of a word: affixes of one to three characters, character bigrams and trigrams with the word's ends, the
word itself, and the languages whose learned lexicon has it. Transitions are learned with them, from
sequences that change language as code-switched text does: runs of 4 to 40 words of labelled documents, put
one after the other. Forward-backward gives each word its posterior; a document's language has the
largest mean posterior over its words with a letter, which is the score.

Training takes TRAIN_DOCS documents at most, shared out over all languages, but EACH of every language where there are very many (those of
about the smallest id hashes), of TRAIN_BYTES at most each, with a language and not held out: crc32 of the id as text is no multiple of
HOLD_OUT. The table of feature weights has WEIGHTS numbers at most: with many languages, features share buckets. Ids,
languages and sources are no input of a prediction.

Defined results: a null text or one without letters is `und` with score 0; without any training row all are;
a null doc_id counts as held out; repeated rows are judged each; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafquarry.llm import common

HOLD_OUT, TRAIN_DOCS, EACH, TRAIN_BYTES = 5, 1200, 4, 1 << 17
#: Feature weights of all languages together, and feature buckets at most.
WEIGHTS = 1 << 23
BUCKETS, STEPS, RATE, DECAY = 1 << 17, 40, 0.15, 1e-4
LEXICON_DOCS, SEQUENCE = 3, 96
#: Words scored together, and distinct words whose scores a worker keeps.
TOGETHER, CACHED = 1_000_000, 1_000_000

_hash = xxhash.xxh32_intdigest


def buckets_for(n_labels: int) -> int:
    return min(BUCKETS, max(256, 1 << (WEIGHTS // max(n_labels, 1)).bit_length() - 1))


def features(word: str, lexicon: dict[str, tuple[int, ...]], buckets: int = BUCKETS) -> list[int]:
    """Buckets of the features of a lower-cased word; none if it has no letter."""
    if not any(map(str.isalpha, word)):
        return []
    w = f"^{word}$"
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)] + [f"w{word}"]
    names += [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    names += [f"l{k}" for k in lexicon.get(word, ())]
    return [_hash(x) % buckets for x in names]


def words_of(text: bytes | None) -> list[str]:
    return b" ".join(common.plain_words(text)).decode("utf-8", "replace").lower().split(" ") if text else []


def chain(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Posteriors of every word of many sequences, by forward-backward over all of them at once.

    scores: a row of label scores for each word; sequence i is rows starts[i] to starts[i] + lengths[i] - 1. With
    pairs, also the expected counts of transitions and the sum of the log partition functions.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    top = scores.max(axis=1, keepdims=True)
    e, m = np.exp(scores - top), np.exp(trans)
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    alpha, norm = np.zeros_like(e), np.ones(len(e))
    prev = None
    for t, k in enumerate(alive):
        at = starts[:k] + t
        a = e[at] * (np.exp(first) if prev is None else prev[:k] @ m)
        z = a.sum(axis=1)
        prev = a / z[:, None]
        alpha[at], norm[at] = prev, z
    post, expected = np.zeros_like(e), np.zeros_like(m)
    beta = np.ones((len(starts), e.shape[1]))
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = starts[:k] + t
        if t + 1 < len(alive) and (n := alive[t + 1]):
            nxt = e[at[:n] + 1] * beta[:n] / norm[at[:n] + 1, None]
            if pairs:
                expected += m * (alpha[at[:n]].T @ nxt)
            beta[:n] = nxt @ m.T
        p = alpha[at] * beta[:k]
        post[at] = p / p.sum(axis=1, keepdims=True)
    return (post, expected, float(np.log(norm).sum() + top.sum())) if pairs else post


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, tuple[int, ...]], weights: np.ndarray, trans: np.ndarray, first: np.ndarray):
        self.labels, self.lexicon, self.weights, self.trans, self.first = labels, lexicon, weights, trans, first
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.labels)), np.float32)
        self.letters = np.zeros(1024, bool)

    def __getstate__(self):
        return (self.labels, self.lexicon, self.weights, self.trans, self.first)

    def __setstate__(self, state):
        self.__init__(*state)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Rows of self.scores for words; new ones are scored once."""
        new = list(dict.fromkeys(w for w in words if w not in self.index))
        if len(self.index) + len(new) > CACHED:
            self.reset()
            new = list(dict.fromkeys(words))
        if new:
            lists = [features(w, self.lexicon, len(self.weights)) for w in new]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for f in lists for x in f), np.int64, int(sizes.sum()))
            sums = np.zeros((len(new), len(self.labels)), np.float32)
            if len(flat):
                some = sizes > 0
                cuts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                for lo in range(len(self.labels)):
                    sums[some, lo] = np.add.reduceat(self.weights[flat, lo], cuts)
            base = len(self.index)
            while base + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.scores[base : base + len(new)] = sums
            self.letters[base : base + len(new)] = sizes > 0
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def posteriors(self, docs: list[list[str]]):
        """(posterior of each word, which words have letters, start of each document) for documents together."""
        at = self.look_up([w for d in docs for w in d])
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        some = lengths > 0
        post = chain(self.scores[at].astype(np.float64), starts[some], lengths[some], self.trans, self.first) if len(at) and self.labels else np.zeros((len(at), len(self.labels)))
        return post, self.letters[at], starts

    def predict(self, docs: list[list[str]]) -> list[tuple[str, float]]:
        post, letters, starts = self.posteriors(docs)
        out = []
        sums = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(post * letters[:, None], axis=0)])
        counts = np.concatenate([[0], np.cumsum(letters)])
        for s, d in zip(starts.tolist(), docs, strict=True):
            n = int(counts[s + len(d)] - counts[s])
            if not n or not self.labels:
                out.append(("und", 0.0))
                continue
            mean = (sums[s + len(d)] - sums[s]) / n
            k = int(mean.argmax())
            out.append((self.labels[k], min(1.0, max(0.0, float(mean[k])))))
        return out


def fit(rows: list[tuple[bytes, str]]) -> Model:
    """A model from (text, language) rows, by gradient ascent on the regularised likelihood."""
    labels = sorted({lang for _, lang in rows})
    docs = [([w for w in words_of(t) if w], labels.index(lang)) for t, lang in rows]
    r = np.random.default_rng(7)
    seen: dict[str, Counter] = {}
    for words, y in docs:
        for w in set(words):
            seen.setdefault(w, Counter())[y] += 1
    lexicon = {w: tuple(sorted(y for y, n in c.items() if n >= LEXICON_DOCS)) for w, c in seen.items() if max(c.values()) >= LEXICON_DOCS}
    runs, left = [], [[0, words, y] for words, y in docs if words]
    while left:  # runs of documents in turn, in random order
        k = int(r.integers(len(left)))
        at, words, y = left[k]
        n = int(r.integers(4, 41))
        runs.append((words[at : at + n], y))
        left[k][0] += n
        if left[k][0] >= len(words):
            left[k] = left[-1]
            left.pop()
    flat = [w for ws, _ in runs for w in ws]
    gold = np.repeat([y for _, y in runs], [len(ws) for ws, _ in runs]).astype(np.int64)
    n_labels, n = len(labels), len(flat)
    buckets = buckets_for(n_labels)
    model = Model(labels, lexicon, np.zeros((buckets, n_labels), np.float32), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    if not n or n_labels < 2:
        return model
    kinds = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(kinds.__getitem__, flat), np.int64, n)
    lists = [features(w, lexicon, buckets) for w in kinds]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    feats, owner = np.fromiter((x for f in lists for x in f), np.int64, int(sizes.sum())), np.repeat(np.arange(len(lists)), sizes)
    starts = np.arange(0, n, SEQUENCE)
    lengths = np.minimum(SEQUENCE, n - starts)
    inner = np.ones(n, bool)
    inner[starts] = False
    want_trans = np.zeros((n_labels, n_labels))
    np.add.at(want_trans, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    want = np.zeros((n, n_labels))
    want[np.arange(n), gold] = 1
    weights, trans, first = np.zeros((buckets, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    mom = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, trans, first)]
    for step in range(1, STEPS + 1):
        emit = np.stack([np.bincount(owner, weights[feats, y], len(lists)) for y in range(n_labels)], axis=1)
        post, expected, _ = chain(emit[ids], starts, lengths, trans, first, pairs=True)
        diff = np.stack([np.bincount(ids, (want - post)[:, y], len(lists)) for y in range(n_labels)], axis=1)
        grads = (
            np.stack([np.bincount(feats, diff[owner, y], buckets) for y in range(n_labels)], axis=1) / n - DECAY * weights,
            (want_trans - expected) / n - DECAY * trans,
            (want[starts] - post[starts]).sum(axis=0) / n - DECAY * first,
        )
        for p, g, (a, b) in zip((weights, trans, first), grads, mom, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p += RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(labels, lexicon, weights.astype(np.float32), trans, first)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fits on documents of every language that a label names. Languages are counted in one scan without texts; a second one
    reads the texts of ids whose hash is under the share that a language needs.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = common.cut(known.groupBy("lang").agg(F.count("*").alias("n")))
    each = max(EACH, -(-most // max(counts.count(), 1)))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    some = known.join(counts, "lang").filter((F.octet_length("text") <= TRAIN_BYTES) & (place < F.lit(3.0 * each + 20) / F.col("n"))).select("lang", "doc_id", common.bytes_of("text").alias("body"))
    some = common.cut(some)  # three times what is needed or so
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "body")
    rows = some.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= each).orderBy("lang", "doc_id", "body")
    return fit([(bytes(r.body), r.lang) for r in rows.toLocalIterator()])


def identify(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score; with runs also the runs of words of one language."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            out = {"lang_pred": [], "score": []} | ({"runs": []} if runs else {})
            texts, lo = b["text"], 0
            while lo < len(texts):
                part, size = [], 0
                while lo < len(texts) and size < TOGETHER:
                    part.append([w for w in words_of(texts[lo]) if w])
                    size += len(part[-1])
                    lo += 1
                got = held.value.predict(part)
                out["lang_pred"] += [x for x, _ in got]
                out["score"] += [s for _, s in got]
                if runs:
                    post, _, starts = held.value.posteriors(part)
                    best = post.argmax(axis=1)
                    for s, d in zip(starts.tolist(), part, strict=True):
                        y = best[s : s + len(d)]
                        cuts = [0, *(np.flatnonzero(y[1:] != y[:-1]) + 1).tolist(), len(d)] if len(d) else []
                        out["runs"].append([{"start": a, "n": z - a, "lang": held.value.labels[y[a]]} for a, z in zip(cuts, cuts[1:], strict=False)])
            yield out

    got = common.append_columns(common.pick(docs, "doc_id", "text"), ["text"], run, "lang_pred string, score double" + ", runs array<struct<start:int,n:int,lang:string>>" * runs)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", *(["runs"] * runs))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
