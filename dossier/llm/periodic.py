"""Runs: stretches of words that repeat themselves with a period, by Main and Lorentz's divide and conquer.

Words are numbered (interned) and every text is halved again and again. A repetition that crosses a midpoint m repeats m's
neighbourhood at some other place x of the node, p = |x - m| words away. Two Z-functions of the node give how far: forward of
the right half against the node (words from x on that equal those from m on), backward of the reversed left half against the
reversed node. Their sum reaches p exactly where a square of period p touches the midpoint, and both lengths are the ends of the
repetition. An end at the node's border may go on beyond it: one comparison tells, and such an interval is left to the ancestor
that has room for all of it, where it is found with its full extent. Equal intervals keep their smallest period.

All nodes of a level of all texts of a slice are worked on together in NumPy: agreements grow a word a round for those places
that still agree. After ROUNDS words, nodes with places that still agree get the linear-time Z-algorithm, so a text that is
one word over and over costs n log n too.

Every text is worked on by itself, without a shuffle. Null and empty texts have no words and no runs. Memory beyond a text and
its words' numbers (4 bytes each) is bounded by BLOCK places at a time, and by a node's Z-functions (8 bytes a word) where
the linear algorithm runs. Repeated rows come back one for one, a null id is kept (and never made periodic by the query's rule),
columns other than the id and the text are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import slices

#: Shortest run in words, words compared in vectorised rounds, places worked on at a time, bytes cut into words at a time.
SHORTEST, ROUNDS, BLOCK, PART = 12, 32, 1 << 18, 1 << 22

REPORT_SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, n_dropped long, collapsed_sha256 string"


class Interner:
    """Numbers for words, from 1 on."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]

    def of(self, text: bytes) -> np.ndarray:
        """Numbers of the text's words (cut at 0x20 and 0x09-0x0D), made in parts that end between words."""
        out, at = [], 0
        while at < len(text):
            end = at + PART
            while end < len(text) and text[end] not in b" \t\n\v\f\r":
                end += 1
            words = text[at:end].split()
            for w in dict.fromkeys(words):
                if w not in self.numbers:
                    self.numbers[w] = len(self.words)
                    self.words.append(w)
            out.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)

    def joined_sha256(self, numbers: np.ndarray, step: int = 1 << 16) -> str:
        """Of the words with these numbers, joined by one space."""
        digest = hashlib.sha256()
        for at in range(0, len(numbers), step):
            digest.update((b" " if at else b"") + b" ".join(map(self.words.__getitem__, numbers[at : at + step].tolist())))
        return digest.hexdigest()


def z_function(values: np.ndarray) -> np.ndarray:
    """z[i]: how many values from i on equal those from the first on; z[0] is the whole length. Linear time."""
    n = len(values)
    s, z = memoryview(np.ascontiguousarray(values)), array("i", bytes(4 * n))
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return np.frombuffer(z, dtype=np.int32)


def _node_agreements(s: np.ndarray, left: int, mid: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward agreements of the midpoint with each place from left to right (inclusive), by two Z-functions."""
    gap = np.array([-1], dtype=np.int32)
    node = s[left:right]
    forward = z_function(np.concatenate([s[mid:right], gap, node]))[right - mid + 1 :]
    backward = z_function(np.concatenate([s[left:mid][::-1], gap, node[::-1]]))[mid - left + 1 :]
    none = np.zeros(1, dtype=np.int32)
    return np.concatenate([forward, none]), np.concatenate([backward, none])[::-1]


def _grown(s: np.ndarray, x: np.ndarray, mid: np.ndarray, room: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values from x and from mid on agree, at most `room` and ROUNDS; and which places still agree after that."""
    out, active = np.zeros(len(x), dtype=np.int64), np.flatnonzero(room > 0)
    for k in range(ROUNDS):
        if not len(active):
            break
        active = active[s[x[active] + step * k] == s[mid[active] + step * k]]
        out[active] = k + 1
        active = active[room[active] > k + 1]
    return out, active


def _found(x, mid, forward, backward, shortest):
    """(start, end, period) where both agreements make a repetition of period |x - mid|."""
    period, total = np.abs(x - mid), forward + backward
    ok = (total >= period) & (total + period >= shortest) & (period > 0)
    x, mid = x[ok], mid[ok]
    return np.minimum(x, mid) - backward[ok], np.maximum(x, mid) + forward[ok], period[ok]


def runs(s: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs of at least `shortest` values in the texts s[starts[i]:ends[i]], by start, then end.

    s has a value that equals no other before, between and after the texts.
    """
    got = []
    left, right = starts[ends - starts >= shortest], ends[ends - starts >= shortest]
    while len(left):
        mid = (left + right) // 2
        sizes = right - left + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        linear = np.zeros(len(left), dtype=bool)
        for at in range(0, int(offsets[-1]), BLOCK):
            to = min(at + BLOCK, int(offsets[-1]))
            first, last = np.searchsorted(offsets, [at, to - 1], side="right") - 1
            inside = np.diff(np.clip(offsets[first : last + 2], at, to))
            node = np.repeat(np.arange(first, last + 1), inside)
            x = np.arange(at, to) - offsets[node] + left[node]
            m = mid[node]
            near = np.flatnonzero(((s[x] == s[m]) | (s[x - 1] == s[m - 1])) & (x != m))
            x, m, node = x[near], m[near], node[near]
            low, high = np.minimum(x, m), np.maximum(x, m)
            forward, on = _grown(s, x, m, right[node] - high, 1)
            backward, back = _grown(s, x - 1, m - 1, low - left[node], -1)
            linear[node[on]] = linear[node[back]] = True
            done = ~linear[node]
            got.append(_found(x[done], m[done], forward[done], backward[done], shortest))
        for i in np.flatnonzero(linear):
            forward, backward = _node_agreements(s, left[i], mid[i], right[i])
            x = np.arange(left[i], right[i] + 1)
            got.append(_found(x, np.full(len(x), mid[i]), forward.astype(np.int64), backward.astype(np.int64), shortest))
        left, right = np.concatenate([left, mid]), np.concatenate([mid, right])
        large = right - left >= shortest
        left, right = left[large], right[large]
    if not got:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    start, end, period = (np.concatenate(c) for c in zip(*got))
    whole = (s[start - 1] != s[start - 1 + period]) & (s[end] != s[end - period])
    start, end, period = start[whole], end[whole], period[whole]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[fresh], end[fresh], period[fresh]


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The query's rule: every tenth document by crc32 of its id goes on with a period from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = words.copy()
    out[a:] = words[a + np.arange(n - a) % p]
    return out


def as_they_are(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    return words


def found_runs(texts: list[bytes], ids: list[int | None], change: Callable = as_they_are, shortest: int = SHORTEST) -> Iterator[tuple]:
    """For each text: (words' numbers, starts, lengths, periods of its runs, which words are kept), and the numbering."""
    interner = Interner()
    parts = [change(i, interner.of(t)) for i, t in zip(ids, texts)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    ends = starts + sizes
    s = np.zeros(int(ends[-1]) + 1, dtype=np.int32)
    s[np.append(starts - 1, ends[-1])] = -1 - np.arange(len(parts) + 1)
    for part, at in zip(parts, starts):
        s[at : at + len(part)] = part
    start, end, period = runs(s, starts, ends, shortest)
    edges = np.zeros(len(s) + 1, dtype=np.int32)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, end, -1)
    kept = np.cumsum(edges) == 0
    by_text = np.searchsorted(start, np.append(starts, ends[-1] + 1))
    for i, (part, at) in enumerate(zip(parts, starts)):
        own = slice(by_text[i], by_text[i + 1])
        order = np.lexsort((period[own], start[own]))
        yield interner, part, start[own][order] - at, (end[own] - start[own])[order], period[own][order], kept[at : at + len(part)]


def _longest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    if not len(start):
        return (None,) * 4
    i = np.lexsort((period, start, -length))[0]
    return int(start[i]), int(length[i]), int(period[i]), int(1000 * length[i] // period[i])


def run_report(docs: DataFrame, change: Callable = planted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its runs' number and digest, the longest run, and the digest of what is left when each run keeps its first period."""

    def work(batches):
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            texts = [t.encode() for t in (v.as_py() or "" for v in batch.column("text"))]
            rows = []
            for doc_id, (interner, words, start, length, period, kept) in zip(ids, found_runs(texts, ids, change)):
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist()))
                left = words[kept]
                rows.append((doc_id, len(words), len(start), *_longest(start, length, period), hashlib.sha256(listed.encode()).hexdigest(), len(words) - len(left), interner.joined_sha256(left)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)], names=[n.split()[0] for n in REPORT_SCHEMA.split(", ")])

    few = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return few.mapInArrow(work, REPORT_SCHEMA)
