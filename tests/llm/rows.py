"""Rows and small brute-force helpers that several tests share."""

import re
from functools import lru_cache

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (None, "null id text"), (5, "same row"), (5, "same row"), (6, "é ß 日本 ### $$$"), (7, "word " * 30_000), (8, "\x1f odd\x0bspaces\x0c")]
PLAIN, SPACED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(text):
    return PLAIN.findall((text or "").translate(_LOWER))


def spaced(text):
    return SPACED.findall(text or "")


def key(doc_id):
    return (doc_id is None, doc_id or 0)


@lru_cache(maxsize=1)
def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return [*_library().encode(text or "", add_special_tokens=False).ids, 2]
