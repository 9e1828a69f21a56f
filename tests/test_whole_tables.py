"""Queries of the plans over small made-up tables, against brute force over all rows and whole texts."""

import itertools

import pytest

from dossier.plans import registry


@pytest.fixture
def folder(spark, tmp_path):
    """Writes a table and returns the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def got(spark, name, sf_dir):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, sf_dir).collect())


# --- Vectors beyond the first ids ---------------------------------------------------------------------------------------


@pytest.fixture
def vectors(folder):
    """Ids from 196 to 219 in two labels, and what is similar by brute force."""
    rows = [(n, [float((n * 7 + k * 5) % 11) / 20 for k in range(4)], n // 2 % 2) for n in range(196, 220)]
    sims = {(a[2], a[0], b[0]): round(sum(x * y for x, y in zip(a[1], b[1])), 9) for a, b in itertools.product(rows, rows) if a[0] % 2 == 0 and b[0] % 2 and a[2] == b[2]}
    return folder("embeddings", rows, "vec_id long, embedding array<double>, label int"), sims


def test_pairs_of_all_vectors(spark, vectors):
    sf_dir, sims = vectors
    assert got(spark, "pair_similarity", sf_dir) == sorted((*k, round(s, 6)) for k, s in sims.items() if s >= 0.1)
    assert got(spark, "threshold_sweep", sf_dir) == [(t, sum(s >= t for s in sims.values())) for t in (0.1, 0.2, 0.3)]
    best = {}
    for (label, i, _), s in sims.items():
        best[label, i] = max(s, best.get((label, i), s))
    assert got(spark, "critical_items", sf_dir) == sorted((*k, round(s, 6)) for k, s in best.items() if s >= 0.25)


def test_greedy_matches_of_all_vectors(spark, vectors):
    sf_dir, sims = vectors
    want = []
    for t in (0.1, 0.2, 0.3):
        taken = {}
        for s, i, j, label in sorted(((s, i, j, label) for (label, i, j), s in sims.items() if s >= t), reverse=True):
            pairs = taken.setdefault(label, [])
            if all(i != x and j != y for x, y in pairs):
                pairs.append((i, j))
        want += [(label, t, len(pairs)) for label, pairs in taken.items()]
    assert got(spark, "greedy_match_tp", sf_dir) == sorted(want)


# --- Resamples of all labels --------------------------------------------------------------------------------------------


def scrambled(x):
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        x = ((x ^ x >> shift) * factor) % 2**32
    return x ^ x >> 15


def rank(seed, b, i, n):
    high, low = ((scrambled(scrambled(i ^ (key := scrambled(b ^ scrambled((seed + lane * 0x9E3779B9) % 2**32)))) ^ scrambled(key ^ 0x9E3779B9))) for lane in (0, 1))
    return (high * n + (low * n >> 32)) >> 32


def test_bootstrap_of_all_labels(spark, folder):
    """Ids on both sides of 400; 10,000 resamples drawn one by one."""
    rows = [(n, int(n % 4 > 0), int(n % 5 == 0)) for n in range(394, 408)]
    sf_dir, n = folder("labels", rows, "doc_id long, quality int, toxic int"), len(rows)
    by_precision = sorted((int(q == 1 and t == 0), int(t == 1)) for _, q, t in rows)
    by_system = sorted((int(q == 1 and t == 0), int(d % 3 == 0)) for d, q, t in rows)
    values = {"bootstrap_ci": [], "bootstrap_paired_diff": []}
    for b in range(10_000):
        taken = [rank(20261005, b, i, n) for i in range(n)]
        tp, fp = (sum(c) for c in zip(*(by_precision[k] for k in taken)))
        other = sum(by_system[k][1] for k in taken)
        tp_of_system = sum(by_system[k][0] for k in taken)
        values["bootstrap_ci"] += [tp / (tp + fp)] if tp + fp else []
        values["bootstrap_paired_diff"].append((other - tp_of_system) / n)
    for name, seen in values.items():
        seen.sort()
        at = lambda q: (lambda x: seen[int(x)] + (x - int(x)) * (seen[min(int(x) + 1, len(seen) - 1)] - seen[int(x)]))(q * (len(seen) - 1))
        b, mean, lo, hi = got(spark, name, sf_dir)[0]
        assert b == 10_000 and (mean, lo, hi) == pytest.approx((sum(seen) / len(seen), at(0.025), at(0.975)), abs=2e-6)


# --- Benchmarks of another size -----------------------------------------------------------------------------------------


def test_all_benchmark_items_meet_documents(spark, folder):
    """50 items of one word each; a document holds the word of its item."""
    word = lambda n: "item" + "abcdefghij"[n // 10] + "abcdefghij"[n % 10]
    folder("benchmark", [(n, word(n)) for n in range(50)], "item_id long, text string")
    sf_dir = folder("documents", [(n, "en", f"{word(n % 50)}\nother") for n in range(120)], "doc_id long, lang string, text string")
    assert got(spark, "jaccard_tokens", sf_dir) == [(n, n % 50, 0.5) for n in range(120)]
    assert got(spark, "error_kind_pivot", sf_dir) == [("en", 120, 0, 0, 0)]


# --- Averages and whole texts -------------------------------------------------------------------------------------------


def test_macro_row_of_all_documents(spark, folder):
    """60 documents: each shares one of its two words with the next, the last ten with none."""
    word = lambda n: "word" + "abcdefghij"[n // 10] + "abcdefghij"[n % 10]
    rows = [(n, "en", f"{word(n)} {word(n + 1)}" if n < 50 else f"{word(n)} alone{word(n)}") for n in range(60)]
    out = dict((r[0], r[1:]) for r in got(spark, "macro_row", folder("documents", rows, "doc_id long, lang string, text string")))
    assert len(out) == 60 and out["58"] == (0.0, 0.0, 0.0) and out["3"] == (0.5, 0.5, 0.5)
    shared = sum(bool(set(a[2].split()) & set(b[2].split())) for a, b in zip(rows, rows[1:]))
    assert out["AVERAGE"] == (round(shared / 2 / 59, 6),) * 3


@pytest.fixture
def lines(folder):
    """Texts whose later lines hold words and items, one of them after forty blanks."""
    rows = [(0, "en", "s", "alpha, beta\ngamma; delta"), (1, "en", "s", "other\ngamma and delta"), (2, "en", "s", " " * 40 + "epsilon")]
    return folder("documents", rows, "doc_id long, lang string, source string, text string")


def test_word_sets_of_whole_texts(spark, lines):
    assert got(spark, "set_prf_per_doc", lines) == [(0, 2, 1, 2, 0.666667, 0.5, 0.571429), (1, 0, 1, 3, 0.0, 0.0, 0.0)]
    assert got(spark, "set_prf_micro", lines) == [("en", 2, 2, 2, 5, 0.5, 0.285714, 0.363636)]
    assert got(spark, "macro_row", lines)[-1] == ("AVERAGE", 0.333334, 0.25, 0.285715)


def test_items_of_whole_texts(spark, lines):
    assert got(spark, "clean_items", lines) == [(0, 4, "alpha|beta|gamma|delta"), (1, 2, "other|gamma and delta"), (2, 1, "epsilon")]


def test_cleanups_of_whole_texts(spark, lines):
    rows = {r.doc_id: r for r in registry.QUERIES["cleanups"](spark, lines).collect()}
    assert (rows[0].paragraph, rows[0].adverse, rows[0].n_items) == ("alpha, beta gamma; delta", "alpha, beta gamma; delta", 2)
    assert (rows[1].warnings, rows[1].interactions, rows[1]["head"]) == ("other gamma and delta", "other\ngamma, delta", "other\ngamma and delta")


def test_texts_with_blank_heads_are_not_empty(spark, lines, folder):
    fixed = {r[0]: r[1] for r in got(spark, "sentinel_is_empty", folder("empty/documents", [], "text string") + "/empty")}
    assert {r[0]: r[1] for r in got(spark, "sentinel_is_empty", lines)} == {**fixed, False: fixed[False] + 3}


# --- Short documents and later lines of pieces --------------------------------------------------------------------------


def test_pieces_of_all_documents(spark, folder):
    """A short text, one without length, blank and missing ones, and a long one whose items repeat across pieces."""
    long = "\n".join(f"item {n}, Item {n - 1}" for n in range(1, 600))
    rows = [(0, "alpha, beta\nAlpha; gamma", 24), (1, "delta\nepsilon", None), (2, " ", 1), (3, None, None), (4, long, len(long)), (5, "none", 4)]
    sf_dir = folder("documents", rows, "doc_id long, text string, n_chars long")
    pieces = got(spark, "chunk_documents", sf_dir)
    assert len(long) > 8000 and [r[:3] for r in pieces if r[0] != 4] == [(0, 0, 24), (1, 0, 13), (2, 0, 1), (3, 0, 0), (5, 0, 4)]
    assert [r[1] for r in pieces if r[0] == 4] == list(range(len(pieces) - 5)) and len(pieces) > 6
    merged = dict(got(spark, "chunk_merge_dedup", sf_dir))
    assert (merged[0], merged[1], merged[2], merged[3], merged[5]) == ("alpha, beta, gamma", "delta, epsilon", "SECTION_NOT_FOUND", "SECTION_NOT_FOUND", "NONE_FOUND")
    assert {f"item {n}" for n in range(1, 600)} <= {x.lower() for x in merged[4].split(", ")}
