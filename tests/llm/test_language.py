import random
import zlib

import numpy as np

from dossier.llm import language as L


def longest_match_phrases(text, sample, stride):
    """Greedy phrases by looking for substrings; they end at every stride."""
    count = 0
    for at in range(0, len(text), stride):
        row, i = text[at : at + stride], 0
        while i < len(row):
            k = 1
            while i + k < len(row) and row[i : i + k + 1] in sample and row[i : i + k] in sample:
                k += 1
            i, count = i + k, count + 1
    return count


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(L, "STRIDE", 16)
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
    prose = lambda letters, n: " ".join(word(letters) for _ in range(n))
    samples = {"x": [prose("abc", 40)], "y": [prose("bcdé", 40)]}
    model = L.learn(samples)
    joined = {k: L.normalised(v[0]) for k, v in samples.items()}
    texts = [L.normalised(prose(letters, n)) for letters in ("abc", "bcdé", "abcdéfü") for n in (1, 3, 30)] + [b""]
    got = model.phrases(texts)
    assert got.tolist() == [[longest_match_phrases(t, joined[n], 16) for n in model.names] for t in texts]


def test_automaton_has_exactly_the_substrings():
    data = b"abcbcabba"
    moves = L.suffix_automaton(data)

    def walk(word):
        state = 0
        for c in word:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    rng = np.random.default_rng(3)
    for _ in range(500):
        word = bytes(rng.choice(list(b"abc"), rng.integers(0, 6)).tolist())
        assert walk(word) == (word in data)


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.language_report(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.99 * len(held)
    # Neither how rows are dealt nor the held-out documents' columns change anything.
    from pyspark.sql import functions as F

    changed = docs.repartition(5).withColumn("lang", F.when(L.fold(F.col("doc_id")) == 1, F.lit("zz")).otherwise(F.col("lang")))
    assert {r.doc_id: r for r in L.language_report(changed).collect()} == got


def test_awkward_rows(spark, awkward):
    got = L.language_report(awkward).collect()
    assert len(got) == awkward.count()
    learned = {r.lang for r in awkward.collect() if r.lang and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    for r in got:
        assert r.lang_pred in learned | {L.UNKNOWN}
        if r.doc_id in (1, 2):
            assert (r.lang_pred, r.score) == (L.UNKNOWN, 0.0)
        if r.doc_id is None:
            assert r.held_out is False


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert L.language_report(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "some text", None), (2, "123 ...", "en"), (None, "letters", "en")]
    assert {(r.lang_pred, r.score) for r in L.language_report(spark.createDataFrame(rows, schema)).collect()} == {("und", 0.0)}
