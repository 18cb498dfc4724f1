"""The first 32 bits of the MD5 of many short texts with a common start, for draws that every engine can repeat."""
from __future__ import annotations

import hashlib
import math

import numpy as np

_SINE = [np.uint32(int(abs(math.sin(k + 1)) * 2 ** 32)) for k in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda k: k, lambda k: (5 * k + 1) % 16, lambda k: (3 * k + 5) % 16, lambda k: 7 * k % 16]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Texts worked on at once: their few columns of 32 bits stay in the cache.
BATCH = 1 << 13


def digits(numbers: np.ndarray, width: int) -> np.ndarray:
    """Decimal digits of numbers of ``width`` places, as ASCII, a row each."""
    powers = 10 ** np.arange(width - 1, -1, -1, dtype=np.int64)
    return (numbers[:, None] // powers % 10 + 48).astype(np.uint8)


def _block(text: np.ndarray) -> np.ndarray:
    """Rounds of one 64-byte block per row; the words of a row in a column."""
    words = text.view("<u4").T
    words = [w[0] if (w == w[0]).all() else np.ascontiguousarray(w) for w in words]
    a, b, c, d = (np.full(len(text), x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        part = k // 16
        if part in (0, 1):  # choose by b, or by d
            x, y, by = (c, d, b) if part == 0 else (b, c, d)
            np.bitwise_xor(x, y, out=f)
            np.bitwise_and(f, by, out=f)
            np.bitwise_xor(f, y, out=f)
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[_WORD[part](k % 16)]
        np.add(f, word + _SINE[k], out=f)
        turn = _TURN[part][k % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)  # the oldest word's place takes the newest
        a, b, c, d = d, a, b, c
    return a + _START[0]


def first_bits(start: bytes, lead: np.ndarray, places: int) -> np.ndarray:
    """For texts ``start`` + lead + "," + place: the first eight hexadecimal digits of their MD5 as numbers, a row per lead, a column per place from 0 on."""
    out = np.empty((len(lead), places), np.int64)
    with np.errstate(over="ignore"):
        for lo in (0, *(10 ** k for k in range(1, len(str(places))))):
            hi = min(places, max(10, lo * 10))
            if lo >= hi:
                continue
            tail = digits(np.arange(lo, hi), len(str(hi - 1)))
            for width in {len(str(x)) for x in lead.tolist()}:
                rows = np.flatnonzero([len(str(x)) == width for x in lead.tolist()])
                head = digits(lead[rows], width)
                size = len(start) + width + 1 + tail.shape[1]
                if size > 55:  # two blocks
                    for r in rows:
                        out[r, lo:hi] = [int.from_bytes(hashlib.md5(b"%s%d,%d" % (start, lead[r], i)).digest()[:4], "big") for i in range(lo, hi)]
                    continue
                step = max(1, BATCH // (hi - lo))
                for at in range(0, len(rows), step):
                    some = rows[at: at + step]
                    for left in range(0, hi - lo, BATCH):
                        part = tail[left: left + BATCH]
                        text = np.zeros((len(some), len(part), 64), np.uint8)
                        text[:, :, :len(start)] = np.frombuffer(start, np.uint8)
                        text[:, :, len(start): len(start) + width] = head[at: at + step, None]
                        text[:, :, len(start) + width] = ord(",")
                        text[:, :, len(start) + width + 1: size] = part
                        text[:, :, size] = 0x80
                        text[:, :, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
                        out[some, lo + left: lo + left + len(part)] = _block(text.reshape(-1, 64)).byteswap().reshape(len(some), -1)
    return out
