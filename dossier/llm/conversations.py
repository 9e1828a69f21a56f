"""Repair of conversations: the cheapest edits that give a legal order of roles, by a dynamic program over time-major NumPy tensors.

A legal conversation is empty or has an optional system turn and then pairs of user and assistant: `(s?(ua)+)?` in role initials.
Four states follow what was put out: nothing yet, system, user, assistant. Costs are summed from the back: cost[t, c, state] is
the least cost of turns t.. of conversation c. Conversations (cut into segments of at most SEGMENT turns) are put into buckets by length
and each step updates all of a bucket. The stored costs then lead the trace from the front, again all of a bucket at
once: at each turn the first of Delete, Insert, Keep, Rerole that costs no more than the least, which gives the ASCII-least audit.

On Spark:

1. Equal rows of a conversation are counted with map-side aggregation and become one row with its number of copies (all but the first must go).
   Rows whose role and text have an earlier turn are found by the least turn of each (conversation, role, text).
2. Rows are sorted in ranges of (conversation, turn, role, text). A conversation inside a range is repaired there and then.
   The first and the last one of a range, and any that outgrow BLOCK_ROWS or BLOCK_BYTES, are written in blocks of rows, with a piece for
   each range: codes of its turns, and a 4 x 4 matrix of least costs between states.
3. Pieces of a conversation, one a range at most, are chained: exit costs from the back by min-plus products, states from the front by
   composing where each piece leads. Each piece is then traced by itself and its blocks are repaired; their lines are hashed as a stream.

So a conversation may hold any share of the rows: no task holds more than its range of them. Only the last hash, which has
no form that could be split, reads a long conversation's blocks one after the other.

Results: nulls in text and role become one space; a null conversation id is a conversation, null turns come first. Turns that tie are
ordered by role and text. Empty texts are blank. Columns besides conv_id, turn, role, text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, parallelism, release

#: Longest segment of the tensors, cells of one tensor, and rows and bytes of a conversation that are held at once.
SEGMENT, CELLS, BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 20, 4096, 4 << 20

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 40
#: What each state may be followed by, and a row's code: initial's class in the low bits, then the two faults. PAD is no row.
NEXT = np.array([USER, USER, ASSISTANT, USER])
MUST_GO, CUT_SHORT, PAD = 4, 8, 16
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Costs at a conversation's end: a pair that was begun is finished with inserted turns.
LAST = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
#: Decisions: letter in the low bits, then turns inserted before, then the state before.
LETTERS = "DKR"
ENDINGS = np.array([0, 2, 1, 0])


# --- the dynamic program -----------------------------------------------------------------------------------------------


def _kept(codes: np.ndarray) -> np.ndarray:
    """[..., state]: the state that keeping the row leads to, -1 where it may not be kept."""
    kind = codes & 3
    out = np.full((*codes.shape, 4), -1)
    for state in range(4):
        out[..., state] = np.where(kind == NEXT[state], NEXT[state], -1)
    out[..., NOTHING] = np.where(kind == SYSTEM, SYSTEM, out[..., NOTHING])
    return np.where((codes & MUST_GO)[..., None] > 0, -1, out)


def backward(codes: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """codes: [turn, segment], exits: [segment, way, state] costs after the last turn. Costs [turn + 1, segment, way, state]."""
    steps, n = codes.shape
    out = np.empty((steps + 1, n, exits.shape[1], 4), dtype=np.int64)
    out[steps] = exits
    kept = _kept(codes)
    extra = np.where(codes & CUT_SHORT, TRUNCATED, 0)[:, :, None, None]
    stays = (codes & MUST_GO == 0)[:, :, None, None]
    for t in range(steps - 1, -1, -1):
        after = out[t + 1]
        cost = after + DELETE
        keep = np.take_along_axis(after, np.maximum(kept[t], 0)[:, None, :].repeat(after.shape[1], 1), axis=2)
        cost = np.minimum(cost, np.where((kept[t] >= 0)[:, None, :], keep + KEEP + extra[t], FAR))
        cost = np.minimum(cost, np.where(stays[t], after[..., NEXT] + REROLE + extra[t], FAR))
        for _ in range(2):  # more than two inserted turns in a row only lead back
            cost = np.minimum(cost, cost[..., NEXT] + INSERT)
        out[t] = np.where((codes[t] == PAD)[:, None, None], after, np.minimum(cost, FAR))
    return out


def trace(codes: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """costs: [turn + 1, segment, state]. Decisions [turn, segment, entry state] and the states at the end [segment, entry state]."""
    steps, n = codes.shape
    kept = _kept(codes)
    state = np.tile(np.arange(4), (n, 1))
    decisions = np.zeros((steps, n, 4), dtype=np.uint8)
    rows = np.arange(n)[:, None]
    for t in range(steps):
        here, after = costs[t], costs[t + 1]
        before, inserted = state.copy(), np.zeros((n, 4), dtype=np.int64)
        for _ in range(2):
            gone = after[rows, state] + DELETE == here[rows, state]
            more = ~gone & (here[rows, NEXT[state]] + INSERT == here[rows, state])
            inserted += more
            state = np.where(more, NEXT[state], state)
        extra = np.where(codes[t] & CUT_SHORT, TRUNCATED, 0)[:, None]
        gone = after[rows, state] + DELETE == here[rows, state]
        to = kept[t][rows, state]
        keep = ~gone & (to >= 0) & (after[rows, np.maximum(to, 0)] + KEEP + extra == here[rows, state])
        letter = np.where(gone, 0, np.where(keep, 1, 2))
        pad = (codes[t] == PAD)[:, None]
        state = np.where(pad, before, np.where(gone, state, np.where(keep, to, NEXT[state])))
        decisions[t] = before * 16 + inserted * 4 + letter
    return decisions, state


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a vector or a matrix."""
    return np.minimum((a[:, :, None] + b[None]).min(1) if b.ndim == 2 else (a + b[None]).min(1), FAR)


def _buckets(codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, [turn, segment]) of segments of about the same length, in tensors of at most CELLS."""
    sizes = np.array([len(c) for c in codes])
    steps = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for size in np.unique(steps):
        all_of = np.flatnonzero(steps == size)
        most = max(1, CELLS // (int(size) * 16))
        for at in range(0, len(all_of), most):
            some = all_of[at : at + most]
            tensor = np.full((size, len(some)), PAD, dtype=np.int64)
            for column, i in enumerate(some):
                tensor[: sizes[i], column] = codes[i]
            yield some, tensor


def _segments(pieces: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    cuts = [[p[i : i + SEGMENT] for i in range(0, max(len(p), 1), SEGMENT)] for p in pieces]
    return [s for c in cuts for s in c], np.cumsum([0, *map(len, cuts)])


def _segment_matrices(segments: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(segments), 4, 4), dtype=np.int64)
    units = np.where(np.eye(4, dtype=bool), 0, FAR)
    for some, tensor in _buckets(segments):
        out[some] = backward(tensor, np.tile(units, (len(some), 1, 1)))[0].transpose(0, 2, 1)
    return out


def matrices(pieces: list[np.ndarray]) -> np.ndarray:
    """[piece, entry state, exit state]: least costs."""
    segments, bounds = _segments(pieces)
    each = _segment_matrices(segments)
    out = np.empty((len(pieces), 4, 4), dtype=np.int64)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        out[i] = each[a]
        for k in range(a + 1, b):
            out[i] = times(out[i], each[k])
    return out


def solve(pieces: list[np.ndarray], exits: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For pieces with these costs at their ends [piece, state]: costs at their beginnings, decisions [turn, entry state] and final states [piece, entry state]."""
    segments, bounds = _segments(pieces)
    ends = np.empty((len(segments), 4), dtype=np.int64)
    ends[bounds[1:] - 1] = exits
    long = [(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b - a > 1]
    if long:
        each = _segment_matrices([s for _, a, b in long for s in segments[a:b]])
        at = 0
        for _, a, b in long:
            for k in range(b - 2, a - 1, -1):
                ends[k] = times(each[at + k + 1 - a], ends[k + 1])
            at += b - a
    starts, states, decided = np.empty((len(segments), 4), dtype=np.int64), np.empty((len(segments), 4), dtype=np.int64), [np.zeros(0)] * len(segments)
    for some, tensor in _buckets(segments):
        costs = backward(tensor, ends[some][:, None, :])[:, :, 0]
        starts[some] = costs[0]
        decisions, states[some] = trace(tensor, costs)
        for column, i in enumerate(some):
            decided[i] = decisions[: len(segments[i]), column]
    out, final = [], np.empty((len(pieces), 4), dtype=np.int64)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        state, parts = np.arange(4), []
        for k in range(a, b):
            parts.append(decided[k][:, state])
            state = states[k][state]
        out.append(np.concatenate(parts))
        final[i] = state
    return starts[bounds[:-1]], out, final


# --- rows --------------------------------------------------------------------------------------------------------------


def edits(decisions: np.ndarray, copies: np.ndarray) -> str:
    """The initials of one piece's edits; further copies of a row are deleted after it."""
    return "".join("I" * ((d >> 2) & 3) + LETTERS[d & 3] + "D" * (m - 1) for d, m in zip(decisions.tolist(), copies.tolist()))


def repaired(decisions: np.ndarray, roles: list[str], texts: list[str]) -> Iterator[str]:
    """Lines `role:text` that these rows leave."""
    name = {USER: "user", ASSISTANT: "assistant"}
    for d, role, text in zip(decisions.tolist(), roles, texts):
        state = d >> 4
        for _ in range((d >> 2) & 3):
            state = int(NEXT[state])
            yield f"{name[state]}:"
        if d & 3:
            yield f"{role if d & 3 == 1 else name[int(NEXT[state])]}:{text}"


def ending(state: int) -> tuple[str, list[str]]:
    """Edits and lines that finish a conversation."""
    lines = ["user:", "assistant:"][2 - ENDINGS[state] :]
    return "I" * len(lines), lines


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


#: Rows of step 2, whatever becomes of them: counts of a conversation or piece, results, blocks of rows, pieces.
COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")
PIECE_SCHEMA = (
    "kind string, conv_id long, part int, block int, " + ", ".join(f"{c} long" for c in COUNTS) + ", low long, high long, first string, last string, "
    "cost long, audit string, repaired_sha256 string, offset long, roles array<string>, texts array<string>, codes binary, copies array<int>, matrix array<long>"
)
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class _Piece:
    """What one range has of one conversation, taken row by row; rows are held until they make a block."""

    def __init__(self, conv: int | None):
        self.conv, self.count = conv, dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.turn = None
        self.first = self.last = ""
        self.codes, self.copies = bytearray(), []
        self.roles, self.texts, self.held, self.block = [], [], 0, 0

    def add(self, turn, role: str, text: str, copies: int, seen: bool, blank: bool, truncated: bool) -> None:
        initial, c = role[:1], self.count
        c["illegal"] += copies - 1 + (c["n_rows"] > 0 and not _legal(self.last, initial))
        c["n_rows"] += copies
        fault = "blank" if blank else "duplicate" if seen else "truncated" if truncated else None
        c["duplicate"] += 0 if blank else copies - 1
        if fault:
            c[fault] += copies if blank else 1
        if turn is not None:
            c["turns"] += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.first, self.last = self.first if self.codes else initial, initial
        self.codes.append(INITIALS.get(initial, 0) | (MUST_GO if fault in ("blank", "duplicate") else 0) | (CUT_SHORT if fault == "truncated" else 0))
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append(text)
        self.held += len(text) + len(role)

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.held >= BLOCK_BYTES

    def as_block(self, part: int) -> dict:
        row = {"kind": "block", "conv_id": self.conv, "part": part, "block": self.block, "offset": len(self.codes) - len(self.roles), "roles": self.roles, "texts": self.texts}
        self.block += 1
        self.roles, self.texts, self.held = [], [], 0
        return row

    def summary(self) -> dict:
        return {"conv_id": self.conv, **self.count, "low": self.low, "high": self.high, "first": self.first, "last": self.last}

    def as_piece(self, part: int) -> dict:
        matrix = matrices([self.codes_array()])[0].ravel().tolist()
        return {"kind": "piece", "part": part, **self.summary(), "codes": bytes(self.codes), "copies": self.copies, "matrix": matrix}

    def codes_array(self) -> np.ndarray:
        return np.frombuffer(bytes(self.codes), dtype=np.uint8).astype(np.int64)


def _whole(pieces: list[_Piece]) -> Iterator[dict]:
    """Results of conversations that are complete."""
    starts, decisions, states = solve([p.codes_array() for p in pieces], np.tile(LAST, (len(pieces), 1)))
    for p, cost, decided, state in zip(pieces, starts[:, NOTHING], decisions, states[:, NOTHING]):
        copies = np.array(p.copies)
        letters, lines = ending(int(state))
        text = "\n".join([*repaired(decided[:, NOTHING], p.roles, p.texts), *lines])
        extra = int(DELETE * (copies - 1).sum())
        yield {"kind": "done", **p.summary(), "cost": int(cost) + extra, "audit": edits(decided[:, NOTHING], copies) + letters, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _range(batches):
    """Step 2 for one range of sorted rows."""
    part = TaskContext.get().partitionId()
    schema = None
    now: _Piece | None = None
    opened, ready, size = False, [], 0  # opened: the piece now read can't be the whole conversation, or is too large to hold

    def out(rows: list[dict]):
        return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema=schema)

    def closed(last: bool) -> Iterator[dict]:
        if now is not None:
            if opened or last:
                if now.roles:
                    yield now.as_block(part)
                yield now.as_piece(part)
            else:
                ready.append(now)

    schema = pa.schema([*((n, t) for n, t in _ARROW)])
    try:
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "seen", "blank", "truncated"))):
                if now is None or r[0] != now.conv:
                    rows = list(closed(False))
                    size += now.held if now is not None else 0
                    if rows:
                        yield out(rows)
                    if size >= BLOCK_BYTES or len(ready) >= BLOCK_ROWS:
                        yield out(list(_whole(ready)))
                        ready, size = [], 0
                    opened, now = now is None, _Piece(r[0])
                now.add(*r[1:])
                if now.full():
                    opened = True
                    yield out([now.as_block(part)])
        if ready:
            yield out(list(_whole(ready)))
        rows = list(closed(True))
        if rows:
            yield out(rows)
    finally:
        release()


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_ARROW = [(n, _TYPES[t]) for n, t in (c.split(" ") for c in PIECE_SCHEMA.split(", "))]


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one conversation, one a range at most: costs at their ends."""
    pieces = pieces.sort_values("part")
    ends, cost = [], LAST
    for matrix in reversed(pieces["matrix"].tolist()):
        ends.append(cost.tolist())
        cost = times(np.array(matrix).reshape(4, 4), cost)
    return pd.DataFrame({"conv_id": pieces["conv_id"], "part": pieces["part"], "ends": ends[::-1]})


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    """States in which the pieces of one conversation begin, and whether they are its last."""
    pieces = pieces.sort_values("part")
    entries, state = [], NOTHING
    for leads in pieces["leads"]:
        entries.append(state)
        state = int(leads[state])
    final = [-1] * (len(pieces) - 1) + [state]
    return pd.DataFrame({"conv_id": pieces["conv_id"], "part": pieces["part"], "entry": entries, "final": final})


def _traced(batches):
    """What each piece decides and where it leads, for each state in which it may begin."""
    for b in batches:
        for i in range(b.num_rows):
            codes = np.frombuffer(b.column("codes")[i].as_py(), dtype=np.uint8).astype(np.int64)
            starts, decisions, states = solve([codes], np.array([b.column("ends")[i].as_py()], dtype=np.int64))
            row = [pa.array([states[0].tolist()]), pa.array([starts[0].tolist()]), pa.array([decisions[0].tobytes()])]
            yield pa.RecordBatch.from_arrays([b.column("conv_id").slice(i, 1), b.column("part").slice(i, 1), *row], names=["conv_id", "part", "leads", "starts", "decisions"])


def _stats(pieces: DataFrame) -> DataFrame:
    """Counts of whole conversations out of those of their pieces; only neighbouring pieces need looking at."""
    put = F.sort_array(F.collect_list(F.struct("part", "first", "last", "low", "high")))  # one a range at most
    both = lambda f: F.expr(f"aggregate(sequence(1, size(p) - 1), 0L, (n, i) -> n + if({f}, 1, 0))")
    got = pieces.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in COUNTS), F.min("low").alias("low"), F.max("high").alias("high"), put.alias("p"))
    many = F.size("p") > 1
    return got.withColumns({
        "illegal": F.col("illegal") + F.when(many, both("concat(p[i - 1].last, p[i].first) not in ('su', 'ua', 'au')")).otherwise(0),
        "turns": F.col("turns") - F.when(many, both("p[i - 1].high <=> p[i].low and p[i].low is not null")).otherwise(0),
    }).drop("p")


def _streamed(batches):
    """Blocks of conversations, in order: digests of their lines."""
    conv, digest, begun, any_row = None, hashlib.sha256(), False, False
    names = ["conv_id", "repaired_sha256"]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            c, entry, final, offset, decisions, roles, texts = (batch.column(n)[i].as_py() for n in ("conv_id", "entry", "final", "offset", "decisions", "roles", "texts"))
            if any_row and c != conv:
                yield row()
                digest, begun = hashlib.sha256(), False
            conv, any_row = c, True
            mine = np.frombuffer(decisions, dtype=np.uint8).reshape(-1, 4)[:, entry]
            lines = [*repaired(mine, roles, texts), *(ending(final)[1] if final >= 0 else [])]
            if lines:
                digest.update((("\n" if begun else "") + "\n".join(lines)).encode())
                begun = True
    if any_row:
        yield row()


def repair(rows: DataFrame, space: Workspace) -> DataFrame:
    """rows: conv_id, turn, role, text. A row per conversation: RESULT."""
    spark = rows.sparkSession
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies"))
    keyed = space.save(counted.withColumn("digest", F.sha2(F.to_json(F.struct("role", "text")), 256)).withColumn("blank", blank), "rows")
    firsts = keyed.groupBy("conv_id", "digest").agg(F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("some_null"), F.count("*").alias("n")).where("n > 1")
    joined = keyed.join(firsts.withColumnsRenamed({"conv_id": "c", "digest": "d"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    first = F.when(F.col("some_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    seen = F.col("n").isNotNull() & ~first
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    flagged = joined.select("conv_id", "turn", "role", "text", "copies", seen.alias("seen"), "blank", (~last.isin(".", "!", "?")).alias("truncated"))
    ranges = flagged.repartitionByRange(parallelism(spark), "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    made = space.save(ranges.mapInArrow(_range, PIECE_SCHEMA), "ranges", by="kind")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    done = made.where("kind = 'done'").select("conv_id", gaps, *RESULT[2:])

    pieces = made.where("kind = 'piece'")
    ends = pieces.select("conv_id", "part", "matrix").groupBy("conv_id").applyInPandas(_chain, "conv_id long, part int, ends array<long>")
    one = lambda a, b: a.join(b.withColumnsRenamed({"conv_id": "c_", "part": "p_"}), F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("part") == F.col("p_"))).drop("c_", "p_")
    traced = space.save(one(pieces.select("conv_id", "part", "codes"), ends).mapInArrow(_traced, "conv_id long, part int, leads array<long>, starts array<long>, decisions binary"), "traced")
    entries = traced.select("conv_id", "part", "leads").groupBy("conv_id").applyInPandas(_entries, "conv_id long, part int, entry int, final int")
    known = space.save(one(traced, entries), "known")

    by_rows = one(made.where("kind = 'block'").select("conv_id", "part", "block", "offset", "roles", "texts"), known.select("conv_id", "part", "entry", "final", "decisions"))
    size, tail = F.size("roles"), F.col("offset") + F.size("roles")
    blocks = by_rows.select(
        "conv_id", "part", "block", "entry", "offset", "roles", "texts", F.substring("decisions", F.col("offset").cast("int") * 4 + 1, size * 4).alias("decisions"),
        F.when(tail * 4 == F.octet_length("decisions"), F.col("final")).otherwise(-1).alias("final"),
    )
    hashed = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_streamed, "conv_id long, repaired_sha256 string")

    @F.pandas_udf("string")
    def letters(decisions: pd.Series, entry: pd.Series, final: pd.Series, copies: pd.Series) -> pd.Series:
        out = []
        for d, e, f, c in zip(decisions, entry, final, copies):
            out.append(edits(np.frombuffer(d, dtype=np.uint8).reshape(-1, 4)[:, int(e)], np.array(c)) + (ending(int(f))[0] if f >= 0 else ""))
        return pd.Series(out, dtype="object")

    pieced = one(known, pieces.select("conv_id", "part", "copies")).select(
        "conv_id", "part", letters("decisions", "entry", "final", "copies").alias("letters"),
        F.col("starts")[NOTHING].alias("cost"),
        (DELETE * F.aggregate("copies", F.lit(0).cast("long"), lambda n, m: n + m - 1)).alias("more"),
    )
    joined_up = pieced.groupBy("conv_id").agg((F.min_by("cost", "part") + F.sum("more")).alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    on = lambda a, b, name: a.join(b.withColumnRenamed("conv_id", name), F.col("conv_id").eqNullSafe(F.col(name))).drop(name)
    long = on(on(_stats(pieces), joined_up, "c1"), hashed, "c2").select("conv_id", gaps, *RESULT[2:])
    return done.unionByName(long)


def damaged(rows: DataFrame) -> DataFrame:
    """The query's rule: by crc32 of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4 makes it the user's."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(F.col("what") == 1, F.lit("")).when(F.col("what") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(F.col("what") == 4, F.lit("user")).otherwise(text_of("role"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", what.alias("what")).where("what != 0")
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """RESULT for every conversation of the table after damage(); those without rows are empty."""
    space = Workspace(conversations.sparkSession, "conversations")
    table = conversations.select("conv_id", "turn", "role", "text")
    fixed = space.save(repair(damaged(table), space), "repaired")
    everyone = table.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in RESULT[1:7]} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    return everyone.join(fixed.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumns(zero).select(*RESULT)
