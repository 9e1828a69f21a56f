import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from dossier.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, `__row` string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def cheapest(rows):
    """Least path first over (row, output's shape) by (cost, audit): rows as (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, lines = heapq.heappop(heap)
        if (i, shape) in done:
            continue
        done.add((i, shape))
        if i == len(rows) and shape in ("", "a"):
            return cost, audit, "\n".join(lines)
        steps = lambda initial: initial if (shape, initial) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")) else None
        for role in ("user", "assistant"):
            if steps(role[0]) and audit[-3:] != "III":
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, shape, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if steps(role[:1]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if steps(new[0]):
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
    raise AssertionError


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def brute(table):
    out = {}
    rows = damage(table)
    for conv in {r[0] for r in table}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        found = faults([r[2:] for r in mine])
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest(found)
        count = lambda f: sum(x[2] == f for x in found)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made_up(seed, n, longest=9):
    rng = random.Random(seed)
    texts = ["Fine.", "Why?", "cut", "", " \t", "Yes!\n", "no end ", None, "é.", "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv in range(n):
        for _ in range(rng.randrange(1, longest)):
            rows.append((conv or None, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(10**6)}{rng.choice(['', '.'])}"))
    return rows


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(partitions)
    got = C.repair_report(df).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r
    return got


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_awkward_rows(spark):
    check(spark, made_up(5, 250))


@pytest.mark.parametrize("segment, rows, size", [(3, 4, 40), (1, 1, 1), (256, 10**6, 1 << 20)])
def test_one_conversation_in_many_ranges(spark, segment, rows, size):
    """One conversation has nearly all rows, among them many equal ones; it is cut into ranges, blocks and segments."""
    before = C.SEGMENT, C.BLOCK_ROWS, C.BLOCK_BYTES, C._range
    table = made_up(8, 12) + [(7, t, random.Random(t).choice(["user", "assistant", "system"]), f"turn {t % 40}" + "." * (t % 3)) for t in range(300)] + [(7, 5, "user", "same.")] * 50
    C.SEGMENT, C.BLOCK_ROWS, C.BLOCK_BYTES = segment, rows, size

    def small_blocks(batches):
        C.SEGMENT, C.BLOCK_ROWS, C.BLOCK_BYTES = segment, rows, size
        yield from before[3](batches)

    C._range = small_blocks
    try:
        check(spark, table)
    finally:
        C.SEGMENT, C.BLOCK_ROWS, C.BLOCK_BYTES, C._range = before


def test_empty_table(spark):
    assert C.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_segments_agree_with_one_tensor():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(0, 16, n) for n in (1, 2, 7, 40, 300, 0)]
    exits = np.tile(C.LAST, (len(pieces), 1))
    want = C.solve(pieces, exits)
    before, C.SEGMENT = C.SEGMENT, 3
    try:
        got = C.solve(pieces, exits)
    finally:
        C.SEGMENT = before
    assert (got[0] == want[0]).all() and (got[2] == want[2]).all() and all((a == b).all() for a, b in zip(got[1], want[1]))
    for piece, matrix, cost in zip(pieces, C.matrices(pieces), want[0]):
        assert (C.times(matrix, C.LAST)[: len(piece) and 4] == cost[: len(piece) and 4]).all()
