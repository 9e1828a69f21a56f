"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance.

A test item may occur with up to k edits, k = floor(rate * length). It is cut into k + 1 pieces: an occurrence with at most k edits leaves
one of them whole. All pieces of all items go into one Aho-Corasick automaton, which finds exact hits in a single pass over each
text; around every hit Myers' bit-vector algorithm finds the least edit distance of the whole item to any substring of the window.

Both sides are compared lower-cased and with runs of white space as one space. Items whose normal form is shorter than min_chars are
no passages: they match exactly and as whole words, with no edits. Null and empty items and texts match nothing. Items are processed in blocks of at most
BLOCK_CHARS characters, each of which is broadcast, so the benchmark may be of any size. Texts are not shuffled.
Repeated documents and items each count; null ids are kept. Only ids and texts are read. A text of any length is read whole by its task. An empty table of
documents gives an empty result, an empty benchmark no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import slices

RATE, MIN_CHARS, BLOCK_CHARS = 0.07, 40, 8 << 20
SCHEMA = "doc_id long, item_id long, distance int"
_WORD = re.compile(r"\w")


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def bounded(text: str, begin: int, end: int) -> bool:
    """Whether no word goes on across either end of text[begin:end]."""
    inner = lambda at: 0 < at < len(text) and _WORD.match(text[at - 1]) and _WORD.match(text[at])
    return not (inner(begin) or inner(end))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length, with their places."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> int | None:
    """Least edit distance of the pattern to any substring of the text, or None if it is above `most`."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = ones, 0, m, m
    for c in text:
        match = masks.get(c, 0)
        vertical = match | down
        horizontal = (((match & up) + up) ^ up) | match
        plus = down | ~(horizontal | up) & ones
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus = plus << 1 & ones
        up = (minus << 1 & ones) | ~(vertical | plus) & ones
        down = plus & vertical
    return best if best <= most else None


class Finder:
    """Items of one block with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.min_chars = min_chars
        self.items = [(i, text, int(rate * len(text)) if len(text) >= min_chars else 0) for i, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for at, piece in pieces(text, k):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Least distance of each item (by position) that occurs in the normal text."""
        best: dict[int, int] = {}
        if not self.items:
            return best
        done: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, at in places:
                if best.get(n) == 0:
                    continue
                _, item, k = self.items[n]
                begin = end + 1 - length - at
                if len(item) < self.min_chars:
                    if bounded(text, begin, end + 1):
                        best[n] = 0
                    continue
                # A window that lies within the last one searched for this item shows nothing new.
                low, high = max(0, begin - k), min(len(text), begin + len(item) + k)
                if n in done and done[n][0] <= low and high <= done[n][1]:
                    continue
                window = text[low:high]
                done[n] = [low, high]
                got = 0 if item in window else myers(item, window, k)
                if got is not None and got < best.get(n, k + 1):
                    best[n] = got
        return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, streamed from the table: the driver's program holds one at a time, executors get each as a broadcast."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for item_id, text in benchmark.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if size and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance) for every item that occurs in a document within its error budget; documents without one give no row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            finder = Finder(shared.value, rate, min_chars)
            for batch in slices(batches, "text"):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for n, distance in finder.find(normal(text.as_py())).items():
                        rows.append((doc_id, finder.items[n][0], distance))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "distance"])

        part = texts.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the documents in which an item occurs; all columns stay and no row moves."""
    spark = docs.sparkSession
    for block in _blocks(benchmark, "item_id", "text", block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            finder = Finder(shared.value, rate, min_chars)
            for batch in slices(batches, text_col):
                clean = [not finder.find(normal(t.as_py())) for t in batch.column(text_col)]
                if any(clean):
                    yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
