"""Byte-level BPE with pre-token caches, for token counts and packing.

The vocabulary file's library gives the reference result; here texts are split into pre-tokens by an
equivalent pattern for Latin texts, each distinct pre-token is merged once per worker, and only
texts with other characters go to the library as a whole.
"""
from __future__ import annotations

import base64
import re
from array import array
from functools import cache

END_OF_TEXT = "<|endoftext|>"
# Letters and numbers of the Latin blocks up to U+024F; texts with any other non-ASCII character take the library's way.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼½¾"
SPACE = "\t-\r \x85\xa0"
PRE_TOKEN = re.compile(rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
FOREIGN = re.compile(rf"[^\t-\r -~{LETTER}{NUMBER}]")
#: Where cutting in front of single spaces would part a run of white space.
UNCUTTABLE = re.compile(rf"[^\n -~{LETTER}{NUMBER}]|[\n ] |\s\Z")
#: Entries of a task's cache (some 30 MB): it starts afresh when full.
CACHE_ENTRIES = 150_000


@cache
def library():
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@cache
def merges():
    """The same vocabulary as ranks, for merging one pre-token."""
    import public_tokenizers as P
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pre_tokens(text: str) -> list[str] | None:
    """None where the text needs the library's own pattern."""
    return None if FOREIGN.search(text) else PRE_TOKEN.findall(text)


class PieceIds(dict):
    """Pre-token -> its ids as little-endian 32-bit integers."""

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[piece] = array("I", merges()._encode_single_piece(piece)).tobytes()
        return ids


class WordIds(dict):
    """What stands between two single spaces -> ids of it with the space in front."""

    def __init__(self):
        super().__init__()
        self.pieces = PieceIds()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[word] = b"".join(map(self.pieces.__getitem__, PRE_TOKEN.findall(" " + word)))
        return ids


def text_ids(text: str, table: WordIds) -> bytes:
    """The ids of a text as the library gives them, as little-endian 32-bit integers."""
    if END_OF_TEXT in text or not UNCUTTABLE.search(text):
        if END_OF_TEXT in text:
            return array("I", library().encode(text, add_special_tokens=False).ids).tobytes()
        first, *more = text.split(" ")
        start = b"".join(map(table.pieces.__getitem__, PRE_TOKEN.findall(first)))
        return start + b"".join(map(table.__getitem__, more))
    found = pre_tokens(text)
    if found is None:
        return array("I", library().encode(text, add_special_tokens=False).ids).tobytes()
    return b"".join(map(table.pieces.__getitem__, found))
