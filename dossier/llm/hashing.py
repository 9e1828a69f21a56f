"""Vectorised 64-bit hashes of byte ranges and of word shingles."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes hashed at a time, and the longest tables of powers that a worker keeps.
CHUNK, KEPT = 1 << 19, 1 << 20
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if size <= KEPT:
            _tables[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (a splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """Polynomial hashes modulo 2**64 of the windows of a byte array; equal bytes give equal values, so different values prove windows different, but not the reverse."""

    def __init__(self, data: np.ndarray, salt: int = 1):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(salt)) * _powers("up", _BASE, max(n, 1))[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _powers("down", _INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64) * _WORD)

    def grams(self, k: int) -> np.ndarray:
        """Of every k-byte window."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * _powers("down", _INVERSE, len(self.sums))[:n])


def words_of(texts: list[bytes], chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, hash) of every word: runs of bytes outside white space (0x20, 0x09-0x0D), A-Z lower-cased.

    A word's hash is XXH3 of its bytes, taken once for each different word. Polynomials modulo 2**64 won't do: whatever their base, they are equal for
    a Thue-Morse word and its complement. Works in parts that end between words, so memory beyond the result doesn't grow with the texts.
    """
    owners, values = [], []
    known: dict[bytes, int] = {}
    for n, text in enumerate(texts):
        at = 0
        while at < len(text):
            gap = _BLANK.search(text, min(at + chunk, len(text)) - 1)
            stop = gap.end() if gap else len(text)
            words = text[at:stop].lower().split()
            at = stop
            for w in dict.fromkeys(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            if words:
                values.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
                owners.append(np.full(len(words), n, dtype=np.int64))
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(values)


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of several texts at once: (position of the text, hash), sorted by both.

    A text with fewer words than the width has its whole word sequence as its one shingle; one without words has none.
    """
    owner, words = words_of(texts)
    if not len(owner):
        return owner, words
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, len(owner)))
    m = len(words) - width + 1
    got_owner, got = [], []
    if m > 0:
        whole = owner[:m] == owner[width - 1 :]
        value = np.zeros(m, dtype=np.uint64)
        for i in range(width):
            value = value * np.uint64(_BASE) + words[i : i + m]
        got_owner.append(owner[:m][whole])
        got.append(value[whole])
    for f, c in zip(first[count < width], count[count < width]):
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in words[f : f + c]:
                value = value * np.uint64(_BASE) + w
        got_owner.append(owner[f : f + 1])
        got.append(np.array([value], dtype=np.uint64) + np.uint64(int(c)))
    owner, value = np.concatenate(got_owner), mix(np.concatenate(got))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], value[fresh]
