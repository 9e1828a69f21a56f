"""Removal of byte strings that occur more than once, by deep-shallow sorting of suffixes.

Every byte that a string of `length` bytes covers goes, if that string also starts anywhere else: in another row, or elsewhere in
the same one. Strings are judged on the input. The answer is exact (up to 128-bit hashes that identify equal texts and contexts).

How the suffixes are dealt to tasks:

1. Each window of `length` bytes has an anchor, the byte k-gram of least hash in it. Equal windows have equal anchors at the same
   place, so a window whose anchor occurs once is unique. Consecutive windows with one anchor are a run; there is one for every
   eighty bytes or so, and only runs with a repeated anchor go on. Neighbouring runs with equal contexts, which text with a short period is full
   of, are folded into one; their windows repeat, whatever else there is. Equal texts count as one here.
2. A run's context is the bytes its windows cover. Equal contexts fall together, with map-side aggregation: what thousands of
   documents share is one row from here on.
3. Contexts meet by anchor and are sorted there (suffix_order, repeated_windows). The suffixes that start at the anchor are sorted by
   multikey quicksort to a shallow depth; what still shares its prefix goes into a blind trie, which branches on
   single bytes, skips the rest and compares a suffix in full once, at its leaf. From that order the order of the suffixes one
   byte further left is induced, and so on to the first window: a stable partition by the byte in front, with common
   prefixes as range minima. Neighbours that share `length` bytes are repeated windows.
4. An anchor with more than `most` different contexts is split by further anchors, least under other hashes: its contexts are cut into
   runs with 4, then 16 anchors, and at last into single windows, and are sorted in the groups that these make. Windows that
   are equal agree in all anchors, so no group ever has to be larger, and nothing else changes.

Nulls and empty texts have no bytes. Repeated rows, also those that share a doc_id, are separate occurrences. Null ids are kept. Only doc_id
and text are read. Texts of any length are cut into pieces of bounded size that overlap by length - 1 bytes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import RangeHash, mix
from .workspace import Workspace, let_go, parallelism, slices

LENGTH, GRAM, MOST = 200, 40, 4096
#: Bytes hashed at a time, windows sorted at a time, bytes that the quicksort looks at, and anchors by level (0: all of the window).
PIECE, WINDOWS, SHALLOW, LEVELS = 1 << 19, 1 << 18, 16, (1, 4, 16, 0)
_PLACE_BITS = np.uint64(28)
RUNS = "h1 long, h2 long, anchors array<long>, starts array<int>, counts array<int>, places array<int>, times array<int>"
CONTEXT = "start int, repeats boolean, anchor long, n int, place int, digest binary, context binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- runs of windows with the same anchors ------------------------------------------------------------------------------


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values, from the running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, size: np.ndarray, length: int, gram: int, anchors: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchors, for texts of the given sizes that lie one after another in data.

    (text, start in the text, windows, first anchor's place after the start, key of all anchors and their distances). With no anchors each
    window is a run of its own, with the first anchor's place.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, np.zeros(0, dtype=np.uint64)
    first = np.cumsum(size) - size
    hashes = RangeHash(data)
    grams = hashes.grams(gram)
    number = np.arange(len(grams), dtype=np.uint64)

    def least(salt: int) -> np.ndarray:
        value = mix(grams + np.uint64(salt)) if salt else grams
        return (sliding_minimum((value >> _PLACE_BITS << _PLACE_BITS) | number, length - gram + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)

    at = least(0)
    n = len(at)
    owner = np.searchsorted(first, np.arange(n), side="right") - 1
    inside = np.arange(n) + length <= first[owner] + size[owner]
    begin = np.ones(n, dtype=bool)
    begin[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    key = grams[at]
    if anchors == 0:
        begin[:] = True
        key = hashes.of(np.arange(n), np.arange(n) + length)
    for salt in range(1, anchors):
        other = least(salt)
        begin[1:] |= other[1:] != other[:-1]
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grams[other] + (other - at).astype(np.uint64))
    heads = np.flatnonzero(begin & inside)
    valid = np.cumsum(inside)
    ends = np.append(np.flatnonzero(begin), n)
    stop = ends[np.searchsorted(ends, heads, side="right")]
    counts = valid[stop - 1] - valid[heads] + 1
    return owner[heads], heads - first[owner[heads]], counts, at[heads] - heads, key[heads]


def folded(data: np.ndarray, first: np.ndarray, counts: np.ndarray, places: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs stay when neighbours with equal contexts become one, and how many each stands for.

    Text with a period shorter than a window makes a run of each period, and their contexts are equal; in what stays the whole stretch is one run,
    except for its last ones. first: where each run starts in data. Equality is checked byte by byte, in time linear in the stretch.
    """
    follows = (keys[1:] == keys[:-1]) & (counts[1:] == counts[:-1]) & (places[1:] == places[:-1]) & (np.diff(first) == counts[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], follows.astype(np.int8), [0]])))
    keep, times = np.ones(len(first), dtype=bool), np.ones(len(first), dtype=np.int64)
    for a, b in edges.reshape(-1, 2).tolist():  # runs a to b
        n, begin, end = int(counts[a]), int(first[a]), int(first[b] + counts[b]) + length - 1
        differ = np.concatenate([[0], np.cumsum(data[begin : end - n] != data[begin + n : end])])
        at = first[a:b] - begin
        equal = differ[at + n + length - 1] == differ[at]
        keep[a + 1 : b + 1] = ~equal
    heads = np.flatnonzero(keep)
    times[heads] = np.diff(np.append(heads, len(first)))
    return keep, times[keep]


def text_runs(texts: list[bytes], length: int, gram: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of runs_of for texts of any length, in pieces of bounded size, with runs of equal contexts folded, and how many each stands for."""
    parts = [(i, a) for i, t in enumerate(texts) for a in range(0, max(len(t) - length + 1, 0), piece)]
    done = 0
    while done < len(parts):
        block, total = [], 0
        while done < len(parts) and (not block or total < piece):
            i, a = parts[done]
            block.append((i, a, texts[i][a : a + piece + length - 1]))
            total += len(block[-1][2])
            done += 1
        text, offset = np.array([b[0] for b in block]), np.array([b[1] for b in block])
        data, size = np.frombuffer(b"".join(b[2] for b in block), dtype=np.uint8), np.array([len(b[2]) for b in block])
        owner, start, *rest = runs_of(data, size, length, gram)
        keep, times = folded(data, (np.cumsum(size) - size)[owner] + start, *rest, length)
        yield (text[owner][keep], (start + offset[owner])[keep], *(r[keep] for r in rest), times)


# --- deep-shallow sorting ---------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the longest common prefix, at least `low` of which is known."""
    high = min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def blind_trie_order(strings: list[bytes], members: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Members in order of their strings, which share `depth` bytes, and the common prefix of each with the one before (depth for the first).

    An inner node is [branch position, {byte: child}], a leaf the list of its equal members. A string goes down by its bytes at the branch
    positions alone, whatever lies between, and is compared once, with the leaf that it reaches; then its own branch is made.
    """
    byte = lambda s, at: s[at] if at < len(s) else -1
    root: list = [members[0]]
    for m in members[1:]:
        s, node, path = strings[m], root, []
        while isinstance(node[-1], dict):
            path.append(node)
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        same = common_prefix(s, other, depth)
        if same == len(s) == len(other):
            node.append(m)
            continue
        above = [p for p in path if p[0] <= same]
        if above and above[-1][0] == same:
            above[-1][1][byte(s, same)] = [m]
            continue
        below = path[len(above)] if len(above) < len(path) else node
        branch = [same, {byte(other, same): below, byte(s, same): [m]}]
        if above:
            above[-1][1][byte(s, above[-1][0])] = branch
        else:
            root = branch
    order, shared, todo = [], [], [(root, depth)]
    while todo:
        node, before = todo.pop()
        if isinstance(node[-1], dict):
            keys = sorted(node[1], reverse=True)
            todo.extend((node[1][k], node[0]) for k in keys[:-1])
            todo.append((node[1][keys[-1]], before))
        else:
            order += node
            shared += [before] + [len(strings[node[0]])] * (len(node) - 1)
    return order, shared


def suffix_order(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings and the length that each shares with the one before (0 for the first): multikey quicksort, then blind tries."""
    start = common_prefix(min(strings), max(strings)) if len(strings) > 1 else 0
    order, shared = [], []
    todo = [(list(range(len(strings))), start, 0)]
    while todo:
        members, depth, before = todo.pop()
        if len(members) == 1:
            order += members
            shared.append(before)
            continue
        if depth >= start + shallow:
            got, lengths = blind_trie_order(strings, members, depth)
            order += got
            shared += [before, *lengths[1:]]
            continue
        key = [s[depth] if depth < len(s) else -1 for s in (strings[m] for m in members)]
        a, b, c = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        parts = [([m for m, k in zip(members, key) if k < pivot], depth), ([m for m, k in zip(members, key) if k == pivot], depth + 1), ([m for m, k in zip(members, key) if k > pivot], depth)]
        if pivot == -1:  # nothing follows: the strings are equal
            ended = parts[1][0]
            parts[1] = (ended[:1], depth)
            parts[2:2] = [([m], None) for m in ended[1:]]
        waiting, first = [], True
        for part, at in parts:
            if part:
                waiting.append((part, depth if at is None else at, before if first else depth))
                first = False
        todo += reversed(waiting)
    return order, shared


def _range_minima(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of x[first..last] for each pair, from minima over powers of two."""
    out = x[last].copy()
    span, level = last - first + 1, x
    width = 1
    while True:
        here = np.flatnonzero((span >= width) & (span < 2 * width))
        out[here] = np.minimum(level[first[here]], level[last[here] - width + 1])
        if not (span >= 2 * width).any():
            return out
        level = np.minimum(level[:-width], level[width:])
        width *= 2


def repeated_windows(groups: list[list[tuple[bytes, int, int]]], length: int, shallow: int = SHALLOW) -> list[np.ndarray]:
    """groups: lists of contexts (bytes, place of the anchor, windows) with one anchor. For each context, in order, which windows repeat within its group."""
    contexts = [c for g in groups for c in g]
    place = np.array([c[1] for c in contexts])
    counts = np.array([c[2] for c in contexts])
    base = np.cumsum(counts) - counts
    data = np.frombuffer(b"".join(c[0] for c in contexts), dtype=np.uint8)
    size = np.array([len(c[0]) for c in contexts])
    anchor_at = np.cumsum(size) - size + place
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    order, shared, n = [], [], 0
    for g in groups:
        o, s = suffix_order([c[0][c[1] :] for c in g], shallow)
        order += [i + n for i in o]
        shared += s
        n += len(g)
    order, shared = np.array(order), np.array(shared)
    flags = np.zeros(int(counts.sum()), dtype=bool)

    def mark(left: int) -> None:
        at = np.flatnonzero(shared >= length)
        both = np.union1d(order[at], order[at - 1])
        flags[base[both] + place[both] - left] = True

    mark(0)
    for left in range(1, int(place.max()) + 1):
        keep = place[order] >= left
        if not keep.all():
            kept = np.flatnonzero(keep)
            before = np.concatenate([[0], kept[:-1] + 1])
            shared = _range_minima(shared, before, kept)
            order = order[kept]
        # Induced order: by the byte in front, then as before.
        key = group[order] * 256 + data[anchor_at[order] - left]
        moved = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[moved[1:]] == key[moved[:-1]])
        new = np.zeros(len(order), dtype=shared.dtype)
        new[same + 1] = 1 + _range_minima(shared, moved[same] + 1, moved[same + 1])
        order, shared = order[moved], new
        mark(left)
    return np.split(flags, base[1:])


def spans_of(flags: np.ndarray) -> list[int]:
    """Maximal runs of true flags as first and last, flattened."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


# --- tables -----------------------------------------------------------------------------------------------------------


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), columns.values())], names=list(columns))


_CONTEXT = {"start": pa.int32(), "repeats": pa.bool_(), "anchor": pa.int64(), "n": pa.int32(), "place": pa.int32(), "digest": pa.binary(), "context": pa.binary()}


def _answers(rows: DataFrame, owner: dict[str, str], space: Workspace, length: int, gram: int, most: int, level: int = 0) -> DataFrame:
    """rows: runs (columns of `owner`, then of CONTEXT). For each owner the spans, relative to the owner, of its windows that repeat."""
    spark = rows.sparkSession
    mark = F.xxhash64(*owner, "start")
    shared = rows.groupBy("anchor", "digest", "n").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.max("repeats").alias("repeats"), F.first("context").alias("context"), F.first("place").alias("place"))
    distinct = space.save(shared.select("anchor", "digest", "n", "place", (F.col("repeats") | (F.col("lo") != F.col("hi"))).alias("repeats"), "context"), "distinct")
    groups = space.save(distinct.groupBy("anchor").agg(F.count("*").alias("members")), "groups")
    # A context that occurs several times repeats whole; it still has to meet the others of its anchor.
    alone = distinct.where("repeats").join(groups.where("members = 1"), "anchor", "left_semi").select("anchor", "digest", F.array(F.lit(0), F.col("n") - 1).alias("spans"))

    def sort(batches):
        block: list[tuple] = []
        total = 0

        def flush():
            cuts = [i for i in range(len(block)) if i == 0 or block[i][0] != block[i - 1][0]] + [len(block)]
            flags = repeated_windows([[(r[3], r[4], r[2]) for r in block[a:b]] for a, b in zip(cuts, cuts[1:])], length)
            return _batch([(r[0], r[1], [0, r[2] - 1] if r[5] else spans_of(f)) for r, f in zip(block, flags)], {"anchor": pa.int64(), "digest": pa.binary(), "spans": pa.list_(pa.int32())})

        for batch in slices(batches, "context"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "context", "place", "repeats"))):
                if total >= WINDOWS and row[0] != block[-1][0]:
                    yield flush()
                    block, total = [], 0
                block.append(row)
                total += row[2]
        if block:
            yield flush()

    last = level + 1 == len(LEVELS)
    meeting = distinct.join(groups.where("members > 1" if last else f"members > 1 and members <= {int(most)}").select("anchor"), "anchor")
    dealt = meeting.repartition(parallelism(spark), "anchor").sortWithinPartitions("anchor", "digest").select("anchor", "digest", "n", "context", "place", "repeats")
    found = alone.unionByName(dealt.mapInArrow(sort, "anchor long, digest binary, spans array<int>"))
    crowded = groups.where(F.col("members") > most).select("anchor")
    if not last and crowded.limit(1).count():

        def split(batches):
            for batch in slices(batches, "context"):
                raw = batch.column("context").to_pylist()
                size = np.array([len(c) for c in raw])
                owners, starts, counts, places, keys = (x.tolist() for x in runs_of(np.frombuffer(b"".join(raw), dtype=np.uint8), size, length, gram, LEVELS[level + 1]))
                above, digest, repeats = (batch.column(c).to_pylist() for c in ("anchor", "digest", "repeats"))
                out = []
                for i, s, n, p, k in zip(owners, starts, counts, places, keys):
                    part = raw[i][s : s + n + length - 1]
                    out.append((above[i], digest[i], s, repeats[i], k - (1 << 64) if k >> 63 else k, n, p, hashlib.md5(part).digest(), part))
                if out:
                    yield _batch(out, {"above": pa.int64(), "above_digest": pa.binary()} | _CONTEXT)

        parts = distinct.join(crowded, "anchor", "left_semi").select("anchor", "digest", "repeats", "context").mapInArrow(split, f"above long, above_digest binary, {CONTEXT}")
        parts = _answers(space.save(parts, "parts"), {"above": "long", "above_digest": "binary"}, space, length, gram, most, level + 1)
        found = found.unionByName(parts.select(F.col("above").alias("anchor"), F.col("above_digest").alias("digest"), "spans"))
    found = space.save(found.where(F.size("spans") > 0), "answers")
    space.drop(distinct)
    let_go(spark)
    moved = F.transform("spans", lambda x: x + F.col("start"))
    return rows.select("anchor", "digest", *owner, "start").join(found, ["anchor", "digest"]).groupBy(*owner).agg(F.flatten(F.collect_list(moved)).alias("spans"))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(h1, h2, copies, spans): for each distinct text, how many rows have it, and the windows that repeat as arrays of [first, last] pairs, flattened."""
    spark = docs.sparkSession
    space = Workspace(spark, "suffixes")

    def find_runs(batches):
        for batch in slices(batches, "text"):
            texts = [t.as_py().encode() for t in batch.column("text")]
            columns = [np.concatenate(c) for c in zip(*text_runs(texts, length, gram))] or [np.zeros(0, dtype=np.int64)] * 6
            cuts = pa.array(np.searchsorted(columns[0], np.arange(len(texts) + 1)).astype(np.int32))
            lists = lambda j, t: pa.ListArray.from_arrays(cuts, pa.array(columns[j].view(np.int64)).cast(t))
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), lists(4, pa.int64()), lists(1, pa.int32()), lists(2, pa.int32()), lists(3, pa.int32()), lists(5, pa.int32())], names=["h1", "h2", "anchors", "starts", "counts", "places", "times"])

    hashed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = hashed.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    long_enough = hashed.where(F.octet_length("text") >= length)
    classes = space.save(long_enough.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    runs = space.save(long_enough.select("h1", "h2", "text").mapInArrow(find_runs, RUNS), "runs")
    single = runs.select("h1", "h2", F.explode(F.arrays_zip("anchors", "starts", "counts", "places", "times")).alias("r"))
    single = single.select("h1", "h2", F.col("r.anchors").alias("anchor"), F.col("r.starts").alias("start"), F.col("r.counts").alias("n"), F.col("r.places").alias("place"), F.col("r.times").alias("times"))
    mark = F.xxhash64("h1", "start")
    repeated = single.groupBy("anchor").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("anchor")
    # Copies of a text fall together here, and not in the join's own tasks, so a hot anchor's can be split.
    wanted = single.join(repeated, "anchor", "left_semi")
    lists = wanted.groupBy("h1", "h2").agg(F.collect_set(F.struct("anchor", "start", "n", "place", "times")).alias("runs")).join(classes.select("h1", "h2", "id"), ["h1", "h2"])
    lists = space.save(lists, "wanted")
    # Windows of a folded run repeat whatever else there is: their stretches are known here.
    stretch = F.array(F.col("start"), F.col("start") + F.col("n") * F.col("times") - 1)
    stretches = space.save(single.where("times > 1").groupBy("h1", "h2").agg(F.flatten(F.collect_set(stretch)).alias("spans")), "stretches")
    space.drop(runs)
    let_go(spark)

    def cut(batches):
        for batch in slices(batches, "text"):
            rows, held = [], 0
            for h1, h2, text, found in zip(*(batch.column(c) for c in ("h1", "h2", "text", "runs"))):
                raw, h1, h2 = text.as_py().encode(), h1.as_py(), h2.as_py()
                for r in found.as_py():
                    context = raw[r["start"] : r["start"] + r["n"] + length - 1]
                    rows.append((h1, h2, r["start"], r["times"] > 1, r["anchor"], r["n"], r["place"], hashlib.md5(context).digest(), context))
                    held += len(context)
                    if held >= PIECE:
                        yield _batch(rows, {"h1": pa.int64(), "h2": pa.int64()} | _CONTEXT)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, {"h1": pa.int64(), "h2": pa.int64()} | _CONTEXT)

    contexts = space.save(hashed.join(lists, ["id", "h1", "h2"]).select("h1", "h2", "text", "runs").mapInArrow(cut, f"h1 long, h2 long, {CONTEXT}"), "contexts")
    space.drop(lists)
    let_go(spark)
    spans = _answers(contexts, {"h1": "long", "h2": "long"}, space, length, gram, most).unionByName(stretches)
    spans = spans.groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    found = space.save(classes.select("h1", "h2", "copies").join(spans, ["h1", "h2"], "left").where("copies > 1 or spans is not null"), "found")
    space.drop(contexts)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    found = repeated_bytes(docs, id_col, text_col, length, gram, most)

    def finish(batches):
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text, copies, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "copies", "spans"))):
                raw = text.as_py().encode()
                removed, kept, at = spans_to_remove(len(raw), copies.as_py(), spans.as_py(), length), hashlib.sha256(), 0
                for a, b in removed:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((doc_id.as_py(), len(raw), sum(b - a for a, b in removed), len(removed), kept.hexdigest()))
            yield _batch(rows, {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    return rows.join(found, ["h1", "h2"], "left").select("doc_id", "text", "copies", "spans").mapInArrow(finish, RESULT)


def spans_to_remove(size: int, copies: int | None, spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that repeated windows cover; a text that several rows have goes whole."""
    if copies and copies > 1 and size >= length:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    pairs = iter(spans or ())
    for first, last in sorted(zip(pairs, pairs)):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out
