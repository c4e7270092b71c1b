"""Word and shingle hashes of whole batches of texts in NumPy, without a Python object per word.

A word's hash is a polynomial in its characters modulo 2**64, taken from prefix sums, then mixed; it depends on nothing
but the word, so every partition of every run gives the same.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public MurmurHash3 fmix64); works on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@functools.cache
def word_table(kind: str) -> np.ndarray:
    """By code point: is it part of a word? ascii: [a-z0-9]; unicode: letters, marks and numbers."""
    table = np.zeros(0x110000, bool)
    if kind == "ascii":
        table[[*range(48, 58), *range(97, 123)]] = True
    else:
        table[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LMN"]] = True
    return table


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def words(texts: list[str], kind: str = "unicode") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of every word of the lower-cased texts, in order, and where each text's words begin (one more entry than texts). None counts as empty."""
    low = [t.lower() if t else "" for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_table(kind)[codes]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * up[: len(codes)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.zeros(len(low) + 1, np.int64)
    np.cumsum(sizes + 1, out=begins[1:])
    return hashes, ends - starts, np.searchsorted(starts, begins)


def word_hash(word: str) -> int:
    """The hash words() gives to one word."""
    return int(words([word], "unicode")[0][0])


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct word n-grams of each text as sorted keys doc << 48 | 48-bit hash, how many each text has, and how many words.

    A text of fewer than n words, but one at least, has its whole word sequence as its one n-gram; a text without words has none. At most 65,536 texts at once.
    """
    h, _, off = words(texts)
    counts = np.diff(off)
    total = np.zeros(len(h), np.uint64)
    for k in range(n):
        c = np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) & (2**64 - 1))
        total[: len(h) - k] += h[k:] * c
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    place = np.arange(len(h)) - np.repeat(off[:-1], counts)
    ok = place + n <= np.repeat(counts, counts)
    gram, doc = mix(total[ok]), doc[ok]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            c = np.uint64((0xA24BAED4963EE407 * (2 * k + 1)) & (2**64 - 1))
            whole[has] += h[off[:-1][short][has] + k] * c
        gram, doc = np.concatenate([gram, mix(whole)]), np.concatenate([doc, short.astype(np.uint64)])
    keys = np.sort((doc << np.uint64(48)) | (gram >> np.uint64(16)))
    keys = keys[np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0] if len(keys) else keys
    return keys, np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(texts)), counts
