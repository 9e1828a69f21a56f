"""Secret scans with one combined deterministic automaton.

All rules are compiled, whole and without bounds on their lengths, into one minimal automaton that reads the bytes of a batch once, from
right to left, and marks where matches of which rule start. Their ends come from the same rules' anchored automaton, whose longest
match is followed from each start. Both are transition arrays; no other matcher is involved, and the work is linear in the bytes.

Spans are leftmost and do not overlap within a kind; those that are shorter than the rule demands are dropped afterwards. They are in code points, end
exclusive, ordered by start and then by the order of RULES.

Null and empty texts have no spans. Rows come back one for one, so ties, repeated rows and null ids are kept as they are.
Only the id and the text are read. There is no shuffle, and memory is bounded by a batch, or by the longest text.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, Scanner, either_case
from .workspace import slices


@dataclass(frozen=True)
class Rule:
    """A match is head and tail; the tail must have at least `least` bytes."""

    kind: str
    head: str
    tail: str
    least: int = 0

    @property
    def pattern(self) -> str:
        return self.head + self.tail


#: The three base kinds, then the kinds that this operator adds.
RULES = (
    Rule("assign", either_case("(password|passwd|secret|token|api_?key)") + "[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 8),
    Rule("access", "", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]+", 32),
    Rule("pem", "-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----", "([A-Za-z0-9+/=\\x20\\x09-\\x0D]*-----END\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----)?"),
    Rule("bearer", "", "eyJ[A-Za-z0-9_-]{6,}\\.eyJ[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]{6,}"),
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("maps", "AIza", "[A-Za-z0-9_-]+", 35),
)
BASE = 3
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Spans:
    """The scanner of all rules, and the automata of the heads before tails of a least length."""

    def __init__(self):
        self.scanner = Scanner([r.pattern for r in RULES])
        self.heads = [Automaton([r.head], anchored=True) if r.head and r.least else None for r in RULES]

    def _tail(self, raw: bytes, start: int, rule: int) -> int:
        """Where the tail of a match begins: after the longest head."""
        head = self.heads[rule]
        at = begin = start
        state = head.starts[0] if head else None
        while head and state != head.dead and at < len(raw):
            state = head.table[state, head.classes[raw[at]]]
            at += 1
            begin = at if head.accept[state] else begin
        return begin

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes, by start and rule."""
        return [[(s, r, e) for s, r, e in found if e - self._tail(raw, s, r) >= RULES[r].least] for raw, found in zip(texts, self.scanner.matches(texts, [r.least for r in RULES]))]


def in_code_points(raw: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans, counted in code points."""
    if not found or raw.isascii():
        return found
    data = np.frombuffer(raw, dtype=np.uint8)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(before[s]), r, int(before[e])) for s, r, e in found]


def _joined(found) -> str:
    return ",".join(f"{RULES[r].kind}:{s}:{e}" for s, r, e in found)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(Spans())

    def run(batches):
        spans = shared.value
        for batch in slices(batches, "text"):
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            rows = []
            for doc_id, raw, found in zip(batch.column(0).to_pylist(), texts, spans.find(texts)):
                found = in_code_points(raw, found)
                base = [x for x in found if x[1] < BASE]
                rows.append((doc_id, *(sum(x[1] == k for x in base) for k in range(BASE)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
