"""Byte-level BPE ids of whole texts inside tasks, from a public tokenizer file whose path is a parameter.

The merges of the file are run by tiktoken, which gives the ids of `tokenizers` (tests compare them) several times faster. Its regex engine
can't hold a run of about a million white-space characters; a piece of text with a run beyond SAFE_RUN is encoded by `tokenizers` itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: How the file splits text before its merges, and how it writes bytes as characters.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Longer texts are encoded in pieces of about so many characters, cut where no token can cross.
PIECE_CHARS = 1 << 18
#: A single blank between two visible characters: splitting starts anew at this blank.
CUT = re.compile(r"(?<=[0-9A-Za-z.,;:!?]) (?=[0-9A-Za-z])")

#: Longest run of white space that tiktoken is given, and what is longer (Python's white space includes that of the pattern).
SAFE_RUN = 100_000
LONG_RUN = re.compile(rf"(?<!\s)\s{{{SAFE_RUN + 1}}}")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _load(path: str) -> tuple[tiktoken.Encoding, dict[str, int], re.Pattern | None]:
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    byte_of = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in described["model"]["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    return encoding, special, marks


@lru_cache(maxsize=2)
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _pieces(text: str):
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = CUT.search(text, start + PIECE_CHARS)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(text: str, path: str) -> list[int]:
    """Ids of a text, as tokenizers' encode(text, add_special_tokens=False) gives them."""
    encoding, special, marks = _load(path)
    if marks and marks.search(text):
        out: list[int] = []
        for part in marks.split(text):
            out.extend([special[part]] if part in special else encode(part, path) if part else [])
        return out
    if len(text) <= SAFE_RUN:
        return encoding.encode_ordinary(text)
    return [i for piece in _pieces(text) for i in (
        _library(path).encode(piece, add_special_tokens=False).ids if LONG_RUN.search(piece) else encoding.encode_ordinary(piece))]


def encode_array(text: bytes | None, path: str, dtype, end: int, shift: int = 0) -> np.ndarray:
    """Ids (plus `shift`) of a UTF-8 text and, last, the id that ends a document. A null text has the latter only."""
    ids = encode(text.decode(), path) if text else []
    out = np.empty(len(ids) + 1, dtype)
    out[:-1] = ids
    if shift:
        out[:-1] += dtype(shift)
    out[-1] = end
    return out
