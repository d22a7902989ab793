"""Token counts of documents under a unigram model, with scores shared in a trie of pre-tokens.

A pre-token is a run of anything but white space with U+2581 before it. Of all ways to cut it into pieces of the
vocabulary, the one of the highest total score counts, of those the one with fewest pieces. The distinct new pre-tokens
of a batch are visited in sorted order, which is the depth-first order of their trie: the forward scores of the
path to the current node are on a stack, so each trie node is scored once however many pre-tokens
share it, and a terminal's count is stored. Terminals stay in the worker up to CACHED of them; the work is local to
a task and nothing is shuffled.

Scores come from a public piece file: a piece of rank r has the integer score -round(10^6 ln(r + 2)), a
character that no piece has costs its UTF-8 bytes as pieces of the rank after the last.

Defined results: a null or empty text has no pre-tokens and no tokens; repeated rows are counted each; an empty
table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache
from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession

from leafquarry.llm import common

MODEL, MARK = "piece_bpe_32k.model", "▁"
CACHED = 1_000_000
#: Pieces in a text are fewer than this; a score and a count share one integer.
UNIT = 1 << 32


class Counter:
    """Counts of pieces by pre-token, for pieces in order of rank."""

    def __init__(self, pieces: list[str], cached: int = CACHED):
        self.scores = {p: -round(1e6 * math.log(r + 2)) * UNIT - 1 for r, p in reversed(list(enumerate(pieces)))}
        self.unknown = -round(1e6 * math.log(len(pieces) + 2)) * UNIT - 1
        self.longest = max(map(len, pieces), default=1)
        self.ends: dict[str, list[int]] = {}
        for p in pieces:
            self.ends.setdefault(p[-1], set()).add(len(p))  # type: ignore[attr-defined]
        self.ends = {c: sorted(n) for c, n in self.ends.items()}
        self.terminals: dict[str, int] = {}
        self.cached = cached
        self.nodes = 0

    def insert(self, words: list[str]) -> dict[str, int]:
        """Counts for distinct pre-tokens, over their trie."""
        out, path, best = {}, "", [0]
        score, ends, unknown = self.scores.get, self.ends.get, self.unknown
        for word in sorted(words):
            shared = len(commonprefix((path, word)))
            del best[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                top = None
                for n in ends(word[j - 1], ()):
                    if n > j:
                        break
                    if (s := score(word[j - n : j])) is not None and (top is None or best[j - n] + s > top):
                        top = best[j - n] + s
                alone = best[j - 1] + unknown * len(word[j - 1].encode("utf-8", "replace"))
                best.append(alone if top is None else top)
                self.nodes += 1
            path, out[word] = word, -best[-1] % UNIT
        return out

    def count(self, words: list[str]) -> list[int]:
        new = {w for w in words if w not in self.terminals}
        if len(self.terminals) + len(new) > self.cached:
            self.terminals = {}
            new = set(words)
        self.terminals.update(self.insert(list(new)))
        return list(map(self.terminals.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str | None = None) -> Counter:
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    return Counter([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_words (pre-tokens), n_tokens."""

    def run(batches):
        for b in batches:
            one, out = counter(path), {"n_words": [], "n_tokens": []}
            held: list[list[str]] = []

            def close(held=held, out=out, one=one):
                counts, at = one.count([w for ws in held for w in ws]), 0
                for ws in held:
                    out["n_words"].append(len(ws))
                    out["n_tokens"].append(sum(counts[at : at + len(ws)]))
                    at += len(ws)
                held.clear()

            size = 0
            for t in b["text"]:
                held.append([MARK + w for w in b"\n".join(common.spaced_words(t)).decode("utf-8", "replace").split("\n")] if common.spaced_words(t) else [])
                size += len(held[-1])
                if size > 500_000:
                    close()
                    size = 0
            close()
            yield out

    return common.append_columns(common.pick(docs, "doc_id", "text"), ["text"], run, "n_words long, n_tokens long").select("doc_id", "n_words", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
