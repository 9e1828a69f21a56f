"""Language by cross-parsing: a text is cut into the longest phrases that occur in a language's sample; the language that needs fewest wins.

Learning: SAMPLE_BYTES of normalised labelled text, shared equally by the languages, one window of at most WINDOW characters from each
sampled document. Each language's sample becomes a suffix automaton, and its transitions a table (state by byte class), so the longest match
from any place is a walk from the root until a transition is missing; there a phrase ends and the next begins.

Reading: texts are lower-cased, everything between letters becomes one space, and the UTF-8 bytes are laid out in rows of STRIDE bytes. All rows walk through
all languages' tables together, a byte a step, in NumPy; phrases end with their row, for all languages alike. Whole texts are read.

A language's phrases are normalised as the cross-parsing estimate of entropy: phrases x log2(length of the sample) / bytes read. The fewest win,
ties go to the least name. The score is the winner's share when each language counts 2 ** (-SHARPNESS x its estimate's distance from the best): 1 for one language only.

Null texts and those without a letter are `und` with score 0; so is everything if nothing can be learned. Documents with equal texts have equal results.
Repeated rows come back one for one, a null id is never learned from and is not held out. Columns other than the id, the text and the language are not read.
An empty table gives an empty result. The sample's bound holds for any number of languages; with more than SAMPLE_BYTES of these
there is nothing left for each, which is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, slices

#: Normalised bytes learned in all, sampled documents a language, characters of each, bytes of a row, how fast the score falls.
SAMPLE_BYTES, DOCUMENTS, WINDOW, STRIDE, SHARPNESS = 1 << 17, 128, 512, 256, 4.0
UNKNOWN = "und"
_REST = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    """Lower-cased letters with one space between words; empty if there is no letter."""
    return _REST.sub(" ", text.lower()).strip().encode()


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton that has all substrings; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in data:
        state = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


@dataclass
class Model:
    """Transitions of all languages in one table; states are offsets into it. The class after the last is no byte at all."""

    names: list[str]
    weights: np.ndarray  # log2 of the samples' lengths
    classes: np.ndarray  # of bytes; 0: in no sample
    table: np.ndarray
    roots: np.ndarray
    first: np.ndarray  # [class, language]: state after the first byte of a phrase

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: phrases that each text takes."""
        pad, owners, rows = self.first.shape[0] - 1, [], []
        for i, t in enumerate(texts):
            n = -(-len(t) // STRIDE)
            row = np.full(n * STRIDE, pad, dtype=np.uint16)
            row[: len(t)] = self.classes[np.frombuffer(t, dtype=np.uint8)]
            rows.append(row.reshape(n, STRIDE))
            owners.append(np.full(n, i))
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        if not rows:
            return out
        steps, owner = np.ascontiguousarray(np.concatenate(rows).T), np.concatenate(owners)
        state = np.repeat(self.roots[None], len(owner), 0)
        count = np.zeros(state.shape, dtype=np.int32)
        for c in steps:
            state = np.take(self.table, state + c[:, None])
            ended = state < 0
            count += ended
            np.copyto(state, np.take(self.first, c, axis=0), where=ended)
        np.add.at(out, owner, count)
        return out


def learn(samples: dict[str, list[str]], most: int = SAMPLE_BYTES) -> Model | None:
    """samples: texts by language, in the order in which they fill the language's share."""
    if not samples:
        return None
    share = most // len(samples)
    if not share:
        raise ValueError(f"{len(samples)} languages can't share a sample of {most} bytes")
    joined = {}
    for name in sorted(samples):
        text = b" ".join(x for x in map(normalised, samples[name]) if x)[:share]
        if text:
            joined[name] = text
    if not joined:
        return None
    used = np.unique(np.frombuffer(b"".join(joined.values()), dtype=np.uint8))
    classes = np.zeros(256, dtype=np.uint16)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 2
    automata = [suffix_automaton(t) for t in joined.values()]
    roots = np.cumsum([0, *map(len, automata)])
    table = np.full((int(roots[-1]), width), -1, dtype=np.int32)
    first = np.repeat((roots[:-1] * width)[None], width, 0).astype(np.int32)
    for k, (moves, root) in enumerate(zip(automata, roots)):
        for state, to in enumerate(moves):
            for byte, target in to.items():
                table[root + state, classes[byte]] = (root + target) * width
        first[1:-1, k] = np.where(table[root, 1:-1] >= 0, table[root, 1:-1], root * width)
        table[root] = -1  # a phrase begins at each step from the root
    table[:, -1] = np.arange(len(table)) * width
    return Model(list(joined), np.log2([len(t) + 1 for t in joined.values()]), classes, table.ravel(), (roots[:-1] * width).astype(np.int32), first)


def rate(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    clean = [normalised(t or "") for t in texts]
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    sizes = np.array([len(c) for c in clean])
    bits = model.phrases(clean) * model.weights / np.maximum(sizes, 1)[:, None]
    best = bits.argmin(1)
    share = 1 / np.exp2(-SHARPNESS * (bits - bits.min(1, keepdims=True))).sum(1)
    return [model.names[b] if n else UNKNOWN for b, n in zip(best, sizes)], [float(s) if n else 0.0 for s, n in zip(share, sizes)]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def learning_sample(docs: DataFrame, documents: int = DOCUMENTS, window: int = WINDOW) -> DataFrame:
    """docs: doc_id, text, lang. (lang, h, piece): of each language up to `documents` of those to learn from, the least by hash in each of as many
    buckets, and of each a window of at most `window` characters that begins at a place by hash. The hash counts ids and sizes, so the choice doesn't depend on how rows are dealt."""
    h = F.xxhash64("doc_id", F.length("text"))
    rows = docs.where("doc_id is not null and lang is not null and text is not null").where(fold(F.col("doc_id")) != 1).withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(documents)))
    few = rows.groupBy("lang", "bucket").agg(F.min("h").alias("h"))
    room = F.greatest(F.length("text") - window, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("h"), room) + 1).cast("int")
    pieces = rows.select("lang", "h", F.substring("text", start, F.lit(window)).alias("piece")).join(few.select("lang", "h"), ["lang", "h"])
    return pieces.groupBy("lang", "h").agg(F.min("piece").alias("piece"))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from those that are not held out and have a language."""
    spark = docs.sparkSession
    space = Workspace(spark, "language")
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    samples: dict[str, list[str]] = {}
    sample = space.save(learning_sample(named), "sample")
    names = [r[0] for r in sample.select("lang").distinct().limit(SAMPLE_BYTES + 1).collect()]
    for lang, _, piece in sorted(sample.orderBy("h").limit(max(len(names), 1) * DOCUMENTS).collect()):
        samples.setdefault(lang, []).append(piece)
    shared = spark.sparkContext.broadcast(learn(samples))

    def work(batches):
        model = shared.value
        for batch in slices(batches, "text"):
            pred, score = rate(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    kind = dict(named.dtypes)["doc_id"]
    return named.select("doc_id", held.alias("held_out"), "text").mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
