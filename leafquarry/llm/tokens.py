"""Byte-pair ids of whole texts by the `tokenizers` library with a public vocabulary file.

A byte-level vocabulary with the usual pattern cuts a text into pre-tokens before it merges anything. Some ends of pre-tokens
show in the bytes alone: a single white space between two other characters, and a stop behind an ASCII letter. Texts are cut there on
Arrow buffers, equal pieces of a batch are found by Arrow's hash table, and only pieces that the worker has not met before go to
the library. The ids are those of encoding the whole text in one plain call: texts that hold the string of an added
token, and vocabularies of any other kind, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafquarry.llm import common

JSON, END = "byte_bpe_50k.json", 2
#: Bytes of pieces and their ids that a worker keeps; beyond it, those not met for longest go.
CACHE_BYTES = 48 << 20
#: Text that is cut into pieces together, and pieces that the library gets at a time.
BYTES, PIECES, BLOCK = 8 << 20, 10_000, 1 << 16

_ONE = re.compile(r" \S+")


def _classes(**kinds) -> tuple[bytes, dict[str, np.uint8]]:
    out = bytearray(256)
    for bit, of in enumerate(kinds.values()):
        for c in of:
            out[c] |= 1 << bit
    return bytes(out), {name: np.uint8(1 << bit) for bit, name in enumerate(kinds)}


#: solid: first bytes of characters that are no white space for sure. unsure: first bytes of three-byte characters of which some are.
_CLASS, _BIT = _classes(
    solid=[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)], tail=range(0x80, 0xC0), unsure=[0xE1, 0xE2, 0xE3], space=b" ", line=b"\n\t\r\x0b\x0c",
    letter=b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", stop=b",.;:!?",
)


def vocabulary(name: str = JSON) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes before which a pre-token ends for sure."""
    n = len(data)
    out = np.zeros(n + 1, bool)
    has = lambda x, name: (x & _BIT[name]) != 0
    for lo in range(0, n - 2, BLOCK):  # what stays in a processor's cache; blocks share three bytes with the next
        part = data[max(0, lo - 2) : lo + BLOCK + 2]
        skip = lo - max(0, lo - 2)
        kind = np.frombuffer(part.tobytes().translate(_CLASS), np.uint8)
        before = has(kind[:-2], "solid")  # an ASCII character, as the first bytes of others are followed by their rest
        at = np.flatnonzero(has(kind[:-2], "tail"))
        at = at[at >= 2]
        before[at] = (part[at - 1] != 0xC2) & ~has(kind[at - 2] | kind[at - 1], "unsure")
        alone = before & has(kind[2:], "solid")
        here = (alone & has(kind[1:-1], "space")) | (has(kind[:-2], "letter") & has(kind[1:-1], "stop"))
        end = lo + 1 + len(here) - skip
        out[lo + 1 : end] |= here[skip:]
        line = np.flatnonzero(alone[skip:] & has(kind[1 + skip : -1], "line")) + lo + 1
        out[line], out[line + 1] = True, True
    return out[:n]


class Encoder:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most, self.end = Tokenizer.from_file(path), cache_bytes, end
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        pre = known.get("pre_tokenizer") or {}
        self.cuttable = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not known.get("normalizer") and not known.get("post_processor")
        self.added = [t["content"] for t in known.get("added_tokens", [])]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.opens = np.zeros(1 + max(self.library.get_vocab(with_added_tokens=True).values(), default=0), bool)
        for token, k in self.library.get_vocab(with_added_tokens=False).items():
            self.opens[k] = token.startswith("Ġ")
        self.met = 0
        self._forget(np.zeros(0, np.int64))

    def _forget(self, left: np.ndarray) -> None:
        """Keep only the pieces of the numbers `left`."""
        if not len(left):
            self.keys, self.ids = pa.array([], pa.binary()), np.zeros(0, np.uint32)
            self.start, self.length, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            return
        of = np.full(len(self.keys), -1, np.int32)
        of[left] = np.arange(len(left))
        kept = of[self.rows] >= 0
        self.hashes, self.rows = self.hashes[kept], of[self.rows[kept]]
        self.keys, self.ids = self.keys.take(pa.array(left)), self._gather(left)
        self.length, self.last = self.length[left], self.last[left]
        self.start = np.cumsum(self.length) - self.length

    def _find(self, hashes: np.ndarray, pieces: pa.Array) -> np.ndarray:
        """Numbers of known pieces, -1 for others. Pieces of equal hash are compared."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)  # in order, for the processor's caches
        rows = np.where(self.hashes[at] == hashes, self.rows[at], -1).astype(np.int64)
        met = np.flatnonzero(rows >= 0)
        same = pc.equal(self.keys.take(pa.array(rows[met])), pieces.take(pa.array(met))).to_numpy(zero_copy_only=False)
        rows[met[~same]] = -1
        return rows

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        length = self.length[rows]
        ends = np.cumsum(length)
        at = np.repeat(self.start[rows] - (ends - length), length)
        at += np.arange(len(at))
        return self.ids[at]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for lo in range(0, len(texts), PIECES) for e in self.library.encode_batch_fast(texts[lo : lo + PIECES], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: pa.Array) -> np.ndarray:
        """Encode new pieces and give their numbers. Those of a space and one run of other characters are encoded as one text, which each of their spaces divides."""
        texts = [p.decode("utf-8", "replace") for p in pieces.to_numpy(zero_copy_only=False)]
        runs, rest = [], []
        for i, t in enumerate(texts):
            (runs if _ONE.fullmatch(t) else rest).append(i)
        order, lengths, ids = [], [], []
        for lo in range(0, len(runs), PIECES):
            some = runs[lo : lo + PIECES]
            got = np.array(self._library(["".join([texts[i] for i in some])])[0], np.uint32)
            at = np.flatnonzero(self.opens[got])
            if len(at) == len(some) and at[0] == 0:
                order += some
                lengths.append(np.diff(at, append=len(got)))
                ids.append(got)
            else:
                rest += some
        for i, got in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            order.append(i)
            lengths.append([len(got)])
            ids.append(np.array(got, np.uint32))
        length, number = np.concatenate(lengths).astype(np.int64), np.empty(len(order), np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, *ids])
        self.last = np.concatenate([self.last, np.full(len(order), self.met)])
        number[order] = len(self.keys) + np.arange(len(order))
        self.keys = pa.concat_arrays([self.keys, pieces.take(pa.array(order, pa.int64()))])
        by = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[by])
        self.hashes, self.rows = np.insert(self.hashes, at, hashes[by]), np.insert(self.rows, at, number[by].astype(np.int32))
        return number

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of each) for texts as slices of data."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        mask = cuts(data)
        mask[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(mask)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        kinds, number, self.met = pieces.dictionary, pieces.indices.to_numpy(), self.met + 1
        hashes = common.word_hashes(kinds.to_numpy(zero_copy_only=False))
        rows = self._find(hashes, kinds)
        if len(new := np.flatnonzero(rows < 0)):
            rows[new] = self._learn(hashes[new], kinds.take(pa.array(new)))
        self.last[rows] = self.met
        rows = rows.astype(np.int32)[number]
        sums = np.concatenate([[0], np.cumsum(self.length[rows])])
        out = self._gather(rows), sums[np.searchsorted(starts, offsets[1:])]
        if self.keys.nbytes + self.ids.nbytes + 36 * len(self.keys) > self.most:
            self._forget(np.sort(np.argsort(-self.last, kind="stable")[: len(self.keys) // 2]))
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i and the end id are ids[offsets[i]:offsets[i + 1]]; a null text is an empty one.

        texts: an Arrow array of strings, or a list.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.string())
        n = len(texts)
        whole = np.full(n, not self.cuttable)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        binary = texts.cast(pa.binary())
        offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(binary.buffers()[2], np.uint8) if n and binary.buffers()[2] else np.zeros(0, np.uint8)
        got, counts, lo = [], [], 0
        while lo < n:
            if whole[lo]:
                ids = np.array(self._library([texts[lo].as_py()])[0], np.uint32)
                got.append(np.append(ids, np.uint32(self.end)))
                counts.append([len(ids) + 1])
                lo += 1
                continue
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES, "right")) - 1)
            hi = min(hi, n, lo + 1 + int(np.argmax(np.append(whole[lo + 1 :], True))))
            ids, ends = self._pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            after = ends + np.arange(1, len(ends) + 1)
            out, body = np.full(len(ids) + len(ends), self.end, np.uint32), np.ones(len(ids) + len(ends), bool)
            body[after - 1] = False
            out[body] = ids
            got.append(out)
            counts.append(np.diff(after, prepend=0))
            lo = hi
        return (np.concatenate(got) if got else np.zeros(0, np.uint32)), np.concatenate([[0], *counts]).cumsum().astype(np.int64)


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file (default: JSON of the public tokenizers)."""
    path = path or vocabulary()
    return common.hold(("encoder", path), lambda: Encoder(path))
