import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import matching as M
from dossier.operators import similarity as V
from dossier.plans import registry


def vectors(spark, rng, n, blocks, name, vec):
    rows = []
    for k in range(n):
        v = rng.normal(size=6).round(3).tolist()
        if k % 17 == 0:
            v = [0.5] * 6  # ties
        rows.append((rng.choice(blocks), k, None if k % 23 == 0 else v[:5] if k % 29 == 0 else v if k % 31 else [None, *v[1:]]))
    return rows, spark.createDataFrame([(None if b == "-" else str(b), k, v) for b, k, v in rows], f"block string, {name} long, {vec} array<float>")


def brute(left, right):
    out = {}
    for b, i, x in left:
        for c, j, y in right:
            if b == c and b != "-" and x and y and len(x) == len(y) and None not in x and None not in y:
                total = 0.0
                for p, q in zip(np.array(x, dtype=np.float32).tolist(), np.array(y, dtype=np.float32).tolist()):
                    total += p * q
                out[str(b), i, j] = round(total, 9)
    return out


@pytest.mark.parametrize("tile, blocks", [(1, ["a", "b", "-"]), (7, ["hot"]), (256, ["a", "b"])])
def test_tiles_against_all_pairs(spark, tile, blocks, monkeypatch):
    monkeypatch.setattr(V, "TILE", tile)
    rng = np.random.default_rng(tile)
    (a, left), (b, right) = vectors(spark, rng, 80, blocks, "i", "a"), vectors(spark, rng, 70, blocks, "j", "b")
    sims = brute(a, b)
    got = {(r.block, r.i, r.j): r.sim for r in V.similar_pairs(left, right, "block", "i", "j", "a", "b", 1.5).collect()}
    assert got == {k: s for k, s in sims.items() if s >= 1.5}
    best = {}
    for (block, i, _), s in sims.items():
        best[block, i] = max(s, best.get((block, i), -9.0))
    assert {(r.block, r.i): r.sim for r in V.nearest(left, right, "block", "i", "a", "b", 1.5).collect()} == {k: s for k, s in best.items() if s >= 1.5}
    counts = {r.threshold: r.pairs for r in V.threshold_counts(left, right, "block", "a", "b", [0.0, 1.5, 99.0]).collect()}
    assert counts == {t: sum(s >= t for s in sims.values()) for t in (0.0, 1.5, 99.0)}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "block string, i long, a array<float>")
    other = none.withColumnsRenamed({"i": "j", "a": "b"})
    assert V.similar_pairs(none, other, "block", "i", "j", "a", "b", 0.1).count() == 0
    assert [r.pairs for r in V.threshold_counts(none, other, "block", "a", "b", [0.1]).collect()] == [0]


def passed(pairs):
    lefts, rights, out = set(), set(), set()
    for s, i, j in sorted(pairs, reverse=True):
        if i not in lefts and j not in rights:
            lefts.add(i), rights.add(j), out.add((i, j))
    return out


def test_a_chain_of_ten_thousand(spark):
    """Each pair waits for the one before it."""
    chain = [(1.0 - n * 1e-5, n // 2 + n % 2, n // 2) for n in range(10_000)]
    got = M.greedy_pairs(spark.createDataFrame([("b", *r) for r in chain], "b string, sim double, i long, j long"), ["b"], "i", "j")
    assert {(r.i, r.j) for r in got.collect()} == passed(chain)


def test_rounds_on_random_pairs(spark, monkeypatch):
    """Without the last pass, random pairs take few rounds."""
    rng = random.Random(6)
    pairs = [(rng.random(), rng.randrange(150), rng.randrange(150)) for _ in range(3000)]
    rounds = []
    monkeypatch.setattr(M, "LEFT_OVER", 0)
    monkeypatch.setattr(M, "written", lambda df, name, write=M.written: (rounds.append(name), write(df, name))[1])
    got = M.greedy_pairs(spark.createDataFrame([("b", *r) for r in pairs], "b string, sim double, i long, j long"), ["b"], "i", "j")
    assert {(r.i, r.j) for r in got.collect()} == passed(pairs) and rounds.count("taken") <= 2 * np.log2(len(pairs))


def counted(pairs, threshold):
    """How many pairs the pass takes at each similarity, by block, one pair after the other."""
    out = {}
    for block in {b for b, _, _, _ in pairs}:
        mine = [(s, i, j) for b, s, i, j in pairs if b == block and s >= threshold]
        sims = {(i, j): s for s, i, j in sorted(mine)}
        for i, j in passed(mine):
            out[block, sims[i, j]] = out.get((block, sims[i, j]), 0) + 1
    return out


@pytest.mark.parametrize("left_over", [60, 1_000_000])
@pytest.mark.parametrize("kind", ["any", "copies", "levels", "one id, several vectors"])
def test_greedy_counts_against_the_pass(spark, left_over, kind, monkeypatch):
    """Vectors of their own, few vectors of many items, vectors of few similarities, and items with several vectors; all in one round and in many."""
    monkeypatch.setattr(M, "LEFT_OVER", left_over)
    monkeypatch.setattr(V, "WIDE", 9)
    rng = np.random.default_rng(left_over)
    n = 70
    if kind in ("any", "one id, several vectors"):
        (a, left), (b, right) = vectors(spark, rng, n, ["a", "b", "-"], "i", "a"), vectors(spark, rng, n - 8, ["a", "b"], "j", "b")
        if kind != "any":
            a, b = [(k, i // 2 if k == "a" else i, v) for k, i, v in a], b + b[:5]
    else:
        pool = [rng.normal(size=4).round(2).tolist() for _ in range(7)] if kind == "copies" else [list(map(float, f"{k:04b}")) for k in range(16)]
        a, b = ([(str(rng.choice(["a", "b"])), int(k), pool[rng.integers(len(pool))]) for k in rng.permutation(m)] for m in (n, n - 8))
    schema = "block string, {0} long, v array<float>"
    left, right = (spark.createDataFrame([(None if k == "-" else str(k), i, v) for k, i, v in r], schema.format(x)) for r, x in ((a, "i"), (b, "j")))
    pairs = []
    for k, i, x in a:
        pairs += [(str(k), s, i, j) for (_, _, j), s in brute([(k, i, x)], b).items()]
    got = M.greedy_counts(left, right, "block", "i", "j", "v", "v", 0.3)
    assert got.columns == ["block", "sim", "n"]
    assert {(r.block, r.sim): r.n for r in got.collect()} == counted(pairs, 0.3)


def test_greedy_matches_do_not_list_all_pairs(spark, tmp_path, monkeypatch):
    """Of 45,000 pairs above the lowest threshold, the query writes a few thousand."""
    rng = np.random.default_rng(3)
    vecs = np.abs(rng.normal(size=(600, 8))).round(3)
    rows = [(n, v.tolist(), n // 2 % 2) for n, v in enumerate(vecs)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []

    def write(df, name, write=M.written):
        out = write(df, name)
        seen.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(M, "LEFT_OVER", 2000)
    monkeypatch.setattr(M, "written", write)
    got = {(r.label, r.threshold): r.tp for r in registry.QUERIES["greedy_match_tp"](spark, str(tmp_path)).collect()}
    taken = {}
    for label in (0, 1):
        sims = brute([(label, n, v) for n, v, k in rows if k == label and n % 2 == 0], [(label, n, v) for n, v, k in rows if k == label and n % 2])
        taken |= counted([(label, s, i, j) for (_, i, j), s in sims.items()], 0.1)
    want = {(k, t): sum(n for (b, s), n in taken.items() if b == k and s >= t) for k in (0, 1) for t in (0.1, 0.2, 0.3)}
    assert got == want and sum(seen) < 12_000


def test_prefixes_of_one_brand(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))
    ours = [("g", word()) for _ in range(150)] + [(None, "a"), ("g", None), ("h", "ab")]
    theirs = [("g", word() + "b") for _ in range(12)] + [(None, "a"), ("g", None)]
    left, right = (spark.createDataFrame(r, "generic string, product string") for r in (ours, theirs))
    close = lambda p, q: p.startswith(q) or q.startswith(p)
    want = [(g, p) for g, p in ours if not any(g is not None and g == h and p is not None and q is not None and close(p, q) for h, q in theirs)]
    out = M.prefix_anti(left, right, "generic", "product")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want)) and 3 <= len(want) < len(ours)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "StartsWith" not in plan and "startswith" not in plan


def test_greedy_rounds_sort_few_rows(spark):
    """What the aggregates of a round get has a few rows for each item and task, not one for each pair, and the best pair of each item."""
    by_hash = F.round(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000, 3)
    pairs = spark.range(0, 200_000, 1, 2).select((F.col("id") % 3).alias("b"), by_hash.alias("sim"), (F.col("id") % 41).alias("i"), (F.col("id") % 4999).alias("j"))
    best = lambda df: {(r.b, r.i): tuple(r.best) for r in df.groupBy("b", "i").agg(F.max(F.struct("sim", "i", "j")).alias("best")).collect()}
    few = M._best_so_far(pairs, ["b", "i"], ["sim", "i", "j"])
    assert best(few) == best(pairs) and few.count() == 2 * 3 * 41
