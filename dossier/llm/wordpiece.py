"""Token counts by greedy longest match, in one pass over a word's characters.

The vocabulary trie has a failure link for each node and, with it, the number of tokens that following the link pops. Counting
a word then needs no token strings: every character moves forward or follows links, and the popped counts are summed.

A word is a run of characters that are not ASCII white space. The word-start mark of the vocabulary is put before it. A word in
which some position has no matching token counts as one unknown token. Null and empty texts have no words and no tokens.
Texts of any length are read whole. Repeated rows come back one for one and null ids are kept; only the id and the text are read, so other columns may have any
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS, CACHE_CHARS = 200_000, 64
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"
#: ASCII white space, as the splitting rule has it.
_SPACES = {c: " " for c in range(9, 14)}


def load_vocabulary(path: str = VOCABULARY) -> list[str]:
    """Ordinary tokens of a sentencepiece file; control, unknown and byte tokens are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class LongestMatch:
    """Trie as one dict a node, failure links and popped-token counts as lists."""

    def __init__(self, vocabulary):
        self.next: list[dict[str, int]] = [{}]
        terminal = [False]
        for token in vocabulary:
            node = 0
            for c in token:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    terminal.append(False)
                node = self.next[node][c]
            terminal[node] = node != 0
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if terminal[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Tokens of the word, or 0 if it can't be split."""
        trie, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for c in word:
            while (to := trie[node].get(c)) is None:
                if fail[node] < 0:
                    return 0
                total += pops[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return 0
            total += pops[node]
            node = fail[node]
        return total


def words_of(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_SPACES).split(" ") if w]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each row. The automaton is built on the driver from a vocabulary file (bounded) and broadcast; there is no shuffle."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(LongestMatch(load_vocabulary(vocabulary)))

    def run(batches):
        automaton, known = shared.value, {}
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words = n_tokens = n_unknown = 0
                for word, n in Counter(words_of(text.as_py())).items():
                    got = known.get(word)
                    if got is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        got = automaton.count(MARK + word)
                        if len(word) <= CACHE_CHARS:
                            known[word] = got
                    n_words += n
                    n_tokens += n * (got or 1)
                    n_unknown += 0 if got else n
                rows.append((doc_id, n_words, n_tokens, n_unknown))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
