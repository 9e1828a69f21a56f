import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from dossier.llm import periodic as P


def all_runs(words, shortest=12):
    """(start, length, smallest period) of every run, by looking at every period."""
    out = {}
    values = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0)
    for p in range(1, len(words) // 2 + 1):
        edges = np.flatnonzero(np.diff(values[:-p] == values[p:], prepend=False, append=False))
        for s, e in edges.reshape(-1, 2).tolist():
            if e + p - s >= max(shortest, 2 * p):
                out.setdefault((s, e + p - s), p)
    return sorted((s, n, p) for (s, n), p in out.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = all_runs(words)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    s, m, p = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, len(found), s, m, p, 1000 * m // p if found else None, sha("".join("%d,%d,%d\n" % r for r in found)), len(drop), sha(kept)


def random_words(rng):
    n, k = rng.choice([0, 1, 11, 12, 13, 30, 100, rng.randrange(200)]), rng.choice([1, 2, 3, 10])
    w = [chr(97 + rng.randrange(k)) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randrange(1, n + 1)
        w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("rounds, block", [(1, 7), (2, 50), (32, 1 << 18)])
def test_runs_of_random_words(rounds, block, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", rounds)
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "PART", rounds)
    rng = random.Random(rounds)
    for _ in range(200):
        docs = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        found = P.found_runs([rng.choice([" ", "\n\t"]).join(w).encode() for w in docs], [None] * len(docs))
        for w, (_, numbers, start, length, period, _) in zip(docs, found):
            assert len(numbers) == len(w) and list(zip(start.tolist(), length.tolist(), period.tolist())) == all_runs(w)


def test_z_function():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        s = rng.integers(0, 2, n).astype(np.int32)
        want = [next((k for k in range(n - i) if s[k] != s[i + k]), n - i) for i in range(n)]
        assert P.z_function(s).tolist() == want


def test_long_repetitive_texts():
    """One word 300,000 times, and a phrase: one run each, in n log n."""
    for phrase, period in ((b"a ", 1), (b"one two three ", 3)):
        _, words, start, length, found, kept = next(P.found_runs([phrase * 300_000 + b"end"], [None]))
        assert (start.tolist(), length.tolist(), found.tolist()) == ([0], [300_000 * period], [period]) and kept.sum() == period + 1


def test_report(spark, small, awkward):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), awkward):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[-1])
        assert sorted((tuple(r) for r in P.run_report(df).collect()), key=key) == sorted((brute(*r) for r in rows), key=key)


def test_empty_table(spark):
    df = P.run_report(spark.createDataFrame([], "doc_id long, text string"))
    assert df.columns == [c.split()[0] for c in P.REPORT_SCHEMA.split(", ")] and df.collect() == []
