"""Near-duplicate documents: MinHash with tensored banding, then exact verification.

Two small collections of `tables` bands each are computed, every band from `rows` minhashes. A table key combines one band of
either collection, so 2 * tables bands give tables**2 keys: the number of minhashes grows with the square root of the keys.

Steps, each of which shrinks what the next one sees:

1. Documents with equal shingle sets form a class, which its smallest doc_id represents.
2. Only classes that share a band of either collection with another class go on, with these bands alone.
3. Their shingle sets are gathered. A shingle that only one of them has can't be in any
   intersection, so a class with too many of those links with nothing, and a pair's overlap is bounded by the rest.
4. Table keys, first those of two bands of the same number for one round, then all. Where a key's classes are already one component it is not
   looked at, so the many keys of a dense group are dropped after a few have connected it.
   Rounds of centres: in each key the class that is in most keys, then the one with the fewest shingles of its own, is the centre, the members of other components are
   compared with it, and what links is one component. A centre has then met everyone in its key and leaves it. A key is
   done when all that is left in it is one component. This work is linear in the members. All keys of one number have one such
   round; of the others only those of at most SMALL classes have them, with CENTRES centres each, until none is left.
5. Classes of larger keys meet in finer keys instead, of FINE minhashes each, so many that a pair at exactly the threshold shares
   none with probability 1e-5. Those of a group of not so near copies, most of which link with nothing, hardly meet there.
6. Finer keys that are still large are taken apart by differences from a centre. The overlap of x and y follows from the numbers of
   shingles in which each differs from the centre and the number of differences that both have; a pair that links must share at
   least a number of them which x, or y, alone determines. So it shares one of the rarest differences of either
   (prefix filter), which are keys for the next rounds. What is so close to the centre that no class outside this
   comparison can link with it then leaves the key. This goes on while it halves the rows of large keys; what it leaves goes through rounds of centres.

Every join has a centre on one side: each pair that shares a key is compared by way of it, bounded away or already connected, apart from
what step 5 misses: no link between components is lost and no group is expanded into all pairs.

Hot groups: copies fall together in step 1 with map-side aggregation. Members of a hot centre are dealt over as many copies of the
centre's set as SPOKES demands. Null or empty texts have no shingles and link with nothing. Rows that share a doc_id are one document.
Rows without doc_id are returned with a null component and kept. Only doc_id and text are read. Texts of any length are shingled whole. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .hashing import mix, shingles
from .workspace import Workspace, let_go, release, slices

SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>"
SETS = "doc_id long, s1 long, n long, shingles array<long>"
#: Share of overlap with a centre from which on a class's differences from it are kept (percent), members for each copy of a centre's set.
CLOSE, SPOKES = 30, 4096
#: Classes of a key that isn't taken apart any more, rounds that take larger ones apart, and centres of a key in a plain round.
SMALL, REFINED, CENTRES = 16, 6, 4
#: Minhashes of a finer key.
FINE = 12
#: Columns of a class in a table key.
MEMBER = ("key", "node", "s1", "n", "common", "component")


def _set_sums(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each text's set and two order-free 64-bit sums that identify it."""
    size = np.bincount(owner, minlength=n)
    at = np.concatenate([[0], np.cumsum(size)])
    sums = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)])
        sums.append((run[at[1:]] - run[at[:-1]]).view(np.int64))
    return size, sums[0], sums[1]


def signatures(docs: DataFrame, tables: int, rows: int, width: int) -> DataFrame:
    """Set size, set identity and the bands of both collections for each row."""
    n_bands = 2 * tables
    rng = np.random.default_rng(20240229)
    salts = rng.integers(1, 1 << 63, n_bands * rows, dtype=np.uint64)
    factors = rng.integers(1, 1 << 63, n_bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in slices(batches, "text"):
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            owner, value = shingles(texts, width)
            size, s1, s2 = _set_sums(owner, value, len(texts))
            full = np.flatnonzero(size)
            starts = np.concatenate([[0], np.cumsum(size)])[full].astype(np.int64)
            bands = np.zeros((len(texts), n_bands), dtype=np.uint64)
            for k in range(n_bands if len(full) else 0):
                band = np.full(len(full), k, dtype=np.uint64)
                for r in range(rows):
                    f = k * rows + r
                    hashed = (value ^ salts[f]) * factors[f]
                    hashed ^= hashed >> np.uint64(32)
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashed, starts))
                bands[full, k] = band
            half = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).view(np.int64)), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(s1), pa.array(s2), half(np.ascontiguousarray(bands[:, :tables])), half(np.ascontiguousarray(bands[:, tables:]))], names=["doc_id", "n_shingles", "s1", "s2", "a", "b"])

    return docs.mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Full shingle sets."""

    def run(batches):
        for batch in slices(batches, "text"):
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            owner, value = shingles(texts, width)
            size, s1, _ = _set_sums(owner, value, len(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s1), pa.array(size.astype(np.int64)), lists], names=["doc_id", "s1", "n", "shingles"])

    return docs.mapInArrow(run, SETS)


def fine_bands(percent: int) -> int:
    """How many bands of FINE minhashes leave a pair at exactly the threshold without a common one with probability 1e-5."""
    return int(np.ceil(np.log(1e-5) / np.log1p(-((percent / 100) ** FINE))))


def fine_keys(sets: DataFrame, bands: int) -> DataFrame:
    """(key, node, s1): a row for each class of sets and band of FINE minhashes."""
    salts, factors = np.random.default_rng(20240301).integers(1, 1 << 63, (2, bands * FINE), dtype=np.uint64)
    factors |= np.uint64(1)

    def run(batches):
        for batch in batches:
            node, s1, lists = (batch.column(k) for k in range(3))
            value = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
            for k in range(bands if len(starts) else 0):
                band = np.full(len(starts), k, dtype=np.uint64)
                for f in range(k * FINE, (k + 1) * FINE):
                    hashed = (value ^ salts[f]) * factors[f]
                    hashed ^= hashed >> np.uint64(32)
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashed, starts))
                yield pa.RecordBatch.from_arrays([pa.array(band.view(np.int64)), node, s1], names=["key", "node", "s1"])
        release()

    return sets.select("node", "s1", "shingles").mapInArrow(run, "key long, node long, s1 long")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key another node has too."""
    keys = rows.groupBy(key).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(key)
    return rows.join(keys, key, "left_semi")


def _settled(percent: int) -> int:
    """Overlap with a centre, in percent, from which on all links of a class within the key have been found.

    One minus the overlap is a metric: a class at least this close can't link with one that is farther than CLOSE.
    """
    return CLOSE + 100 - percent


def _compare(spokes: DataFrame, sets: DataFrame, differences: bool) -> DataFrame:
    """Number of shingles that each class shares with its centre and, if asked for, those in which close ones differ."""
    hub = ["c_node", "c_s1"]
    crowd = spokes.groupBy(*hub).agg(F.count("*").alias("c")).where(F.col("c") > SPOKES).select(*hub, F.ceil(F.col("c") / SPOKES).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("node", "s1"), F.col("parts")), F.lit(0)).cast("int")
    dealt = spokes.join(crowd, hub, "left").withColumn("part", part).drop("parts")
    one = sets.select("node", "s1", F.col("shingles").alias("set_1"))
    two = sets.select(F.col("node").alias("c_node"), F.col("s1").alias("c_s1"), F.col("shingles").alias("set_2")).join(spokes.select(*hub).distinct(), hub, "left_semi").join(crowd, hub, "left")
    two = two.select(*hub, "set_2", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = dealt.join(one, ["node", "s1"]).join(two, [*hub, "part"]).withColumn("shared", F.size(F.array_intersect("set_1", "set_2")))
    out = both.withColumn("c_n", F.size("set_2"))
    if differences:
        close = F.col("meeting") & (F.col("shared") * 100 >= (F.size("set_1") + F.size("set_2") - F.col("shared")) * CLOSE)
        out = out.withColumn("extra", F.when(close, F.array_except("set_1", "set_2"))).withColumn("missing", F.when(close, F.array_except("set_2", "set_1")))
    return out.drop("set_1", "set_2", "part")


def _linked(percent: int) -> Column:
    return F.col("shared") * 100 >= (F.col("n") + F.col("c_n") - F.col("shared")) * percent


def _refined(stars: DataFrame, percent: int, turn: int, space: Workspace) -> DataFrame:
    """Members of finer keys, one for each centre c and difference from it, for the classes close to c; pairs within them that link share such a key or both link with c.

    With m shingles of c missing, e beyond it and weight w = 100 m + percent e, x links with c where over(x) = w_x - W <= 0, with
    W = (100 - percent) |c|, and x with y where they share k differences from c with (100 + percent) k >= w_x + over(y). Two that link
    with c are one component already, so in a pair that matters the heavier one, y, has over(y) > 0. With w_x <= w_y the lighter one needs
    (100 + percent) k >= w_x + max(over(x), 1). As w_x >= percent k, y needs k >= over(y) / 100, and more than w_y / (100 + percent)
    if x doesn't link with c either. Of d differences, ordered by how few have them, one of the first d - k + 1 is therefore shared:
    x is listed by its first, rarest ones (light) and y by some more, which count only where they find such an x. The first shared
    difference leaves 1 + min(differences after it) shared ones at most, which must suffice for somebody in the key.
    """
    hub, side = ["c_node", "c_s1"], ["node", "s1", "n", "common", "component"]
    total = 100 + percent
    close = stars.where("extra is not null").withColumn("w", 100 * F.size("missing") + percent * F.size("extra")).withColumn("over", F.col("w") - (100 - percent) * F.col("c_n"))
    # A hub without a class that fails to link with the centre, or with one component only, has nothing left to find.
    open_hubs = close.groupBy(*hub).agg(F.max("over").alias("far"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("far > 0 and lo < hi").select(*hub)
    each = close.join(open_hubs, hub, "left_semi").select(*hub, *side, "w", "over", F.explode(F.concat("extra", "missing")).alias("shingle"))
    each = space.save(each, "differences")
    # Only differences that classes of several components have can be shared by a pair that matters; the others aren't listed.
    common = each.groupBy(*hub, "shingle").agg(F.count("*").alias("holders"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").drop("lo", "hi")
    own = W.partitionBy(*hub, "node", "s1")
    shared = each.join(common, [*hub, "shingle"]).withColumn("rank", F.row_number().over(own.orderBy("holders", "shingle"))).withColumn("after", F.count("*").over(own) - F.col("rank"))
    untied, most = F.col("over") > 0, F.col("after") + 1
    needs = {
        "light": most * total >= F.col("w") + F.greatest("over", F.lit(1)),
        "heavy": untied & (most * 100 >= F.col("over")) & (most * total > F.col("w")),
        "far": untied & (most * 100 >= F.col("over")),
    }
    prefix = shared.withColumns(needs).where("light or far").select(F.xxhash64(*hub, "shingle", F.lit(turn)).alias("key"), *side, "w", "over", "after", *needs)
    prefix = space.save(prefix, "prefixes")
    keys = prefix.groupBy("key").agg(
        F.min(F.when(F.col("light") & untied, F.col("w"))).alias("lightest"), F.max(F.col("light") & ~untied).alias("tied"), F.max("after").alias("longest"),
        F.min("over").alias("nearest"), F.min(F.when(untied, F.col("over"))).alias("untied"), F.min("component").alias("lo"), F.max("component").alias("hi"),
    ).where("lo < hi and untied is not null").drop("lo", "hi")
    listed = F.col("light") | (F.col("heavy") & (F.col("lightest") <= F.col("w"))) | (untied & F.col("tied"))
    enough = (1 + F.least("after", "longest")) * total >= F.col("w") + F.when(untied, F.col("nearest")).otherwise(F.col("untied"))
    return prefix.join(keys, "key").where(listed & enough).select(*MEMBER)


def _shared_bands(classes: DataFrame, side: str) -> DataFrame:
    """(node, s1, side): for each class its bands (i, band) of one collection that another class has too; classes without any are left out."""
    bands = classes.select("node", "s1", F.posexplode(side).alias("i", "band")).withColumn("key", F.xxhash64("i", "band"))
    return _shared(bands, "key").groupBy("node", "s1").agg(F.collect_list(F.struct("i", "band")).alias(side))


def _mixed_bands(classes: DataFrame, side: str) -> DataFrame:
    """(node, s1, side): for each class those of its bands that classes of several components have; classes without any are left out."""
    bands = classes.select("node", "s1", "component", F.inline(side)).withColumn("key", F.xxhash64("i", "band"))
    mixed = bands.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return bands.join(mixed, "key", "left_semi").groupBy("node", "s1").agg(F.collect_list(F.struct("i", "band")).alias(side))


def _members(classes: DataFrame, labels: DataFrame | None, diagonal: bool) -> DataFrame:
    """A row for each class and table key, with the class's component."""
    if labels is None:
        named = classes.withColumn("component", F.col("node"))
    else:
        named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # A key's classes share its bands: where all that have a band are one component, its keys have nothing to link.
        named = named.drop("a", "b").join(_mixed_bands(named, "a"), ["node", "s1"]).join(_mixed_bands(named, "b"), ["node", "s1"])
    right = F.filter("b", lambda y: y["i"] == F.col("x.i")) if diagonal else F.col("b")
    rows = named.select("node", "s1", "n", "common", "component", "b", F.explode("a").alias("x"))
    return rows.select("node", "s1", "n", "common", "component", "x", F.explode(right).alias("y")).select(F.xxhash64("x.i", "y.i", "x.band", "y.band").alias("key"), "node", "s1", "n", "common", "component")


def _open(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of keys that hold several components, with their numbers, without classes that not even the best match of their key could link with."""
    keys = rows.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("common").alias("best"), F.min("n").alias("least"), F.count("*").alias("size")
    ).where("lo < hi").drop("lo", "hi")
    most = F.least("common", "best")
    return rows.drop("size").join(keys, "key").where(most * 100 >= (F.col("n") + F.greatest("least", most) - most) * percent).select(*MEMBER, "size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, tables: int = 10, rows: int = 3, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; documents link where 100 * intersection >= percent * union."""
    space = Workspace(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = space.save(signatures(docs, tables, rows, width), "signatures")
    identity = ["s1", "s2", "n_shingles"]
    classes = space.save(sigs.where("doc_id is not null and n_shingles > 0").groupBy(*identity).agg(F.min("doc_id").alias("node"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    dense = space.save(_shared_bands(classes, "a").join(_shared_bands(classes, "b"), ["node", "s1"]), "dense")

    # Full sets of those, and how much of each no other one has.
    wanted = dense.select(F.col("node").alias("doc_id"), "s1")
    # The same plan at every size: the texts are dealt by id, however few are wanted.
    texts = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    sets = space.save(shingle_sets(texts, width), "all-sets").join(wanted, ["doc_id", "s1"], "left_semi").dropDuplicates(["doc_id", "s1"])
    sets = space.save(sets.withColumnRenamed("doc_id", "node"), "sets")
    alone = sets.select("node", "s1", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("s1").alias("s1")).where("c = 1")
    own = alone.groupBy("node", "s1").agg(F.count("*").alias("own"))
    sizes = sets.select("node", "s1", "n").join(own, ["node", "s1"], "left").select("node", "s1", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    able = space.save(dense.join(sizes.where(F.col("common") * 100 >= F.col("n") * percent), ["node", "s1"]), "able")
    let_go(docs.sparkSession)

    def settle(active: DataFrame, labels: DataFrame | None, turn: int, slots: int, refine: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """A round of centres: the rows of keys that are still open, and the components so far."""
        rest, new = _round(active, turn, slots, sets, percent, space, refine)
        if new.limit(1).count():
            merged = components(new, space).select(F.col("node").alias("component"), F.col("component").alias("into"))
            rest = _relabel(rest, merged)
            labels = space.save(_grown(labels, merged), "components")
        # A key is done when all that is left in it is one component.
        left = space.save(_open(space.save(rest, "rest"), percent), "left")
        let_go(docs.sparkSession)
        return left, labels

    active, labels = space.save(_open(_members(able, None, True), percent), "members"), None
    if active.limit(1).count():
        _, labels = settle(active, None, 0, 1)
    active = space.save(_open(_members(able, labels, False), percent), "members")
    # Classes of large keys meet in finer ones instead, so that the size of a group of not so near copies doesn't count.
    small, large = active.where(F.col("size") <= SMALL), active.where(F.col("size") > SMALL).select(*MEMBER[1:]).distinct()
    if large.limit(1).count():
        large = space.save(large, "crowded")
        fine = fine_keys(sets.join(large.select("node", "s1"), ["node", "s1"], "left_semi"), fine_bands(percent))
        active = space.save(_open(space.save(fine, "fine").join(large, ["node", "s1"]).select(*MEMBER), percent), "members")
        # What is still large is taken apart while that makes it fewer.
        before = None
        for turn in range(REFINED):
            small = small.unionByName(active.where(F.col("size") <= SMALL))
            active = active.where(F.col("size") > SMALL)
            rows_left = active.count()
            if not rows_left or before and rows_left > before / 2:
                break
            before = rows_left
            active, labels = settle(active, labels, turn, 1, True)
        small = small.unionByName(active)
    if labels is not None:
        small = _relabel(small, labels.select(F.col("node").alias("component"), F.col("component").alias("into")))
    active, turn = space.save(_open(small, percent), "small"), 0
    while active.limit(1).count():
        # What three rounds leave behind is little, and many centres finish it.
        active, labels = settle(active, labels, turn, CENTRES << min(4 * max(turn - 2, 0), 26))
        turn += 1

    # Rows of one doc_id are one document, also where their texts differ.
    rows_of = sigs.join(classes.select(*identity, "node"), identity, "left").drop("a", "b")
    twice = sigs.where("doc_id is not null").groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("doc_id")
    same = space.save(rows_of.join(twice, "doc_id", "left_semi").where("node is not null").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "same")
    if same.limit(1).count():
        ends = same
        for end in ("a", "b") if labels is not None else ():
            ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias("label")), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        merged = components(ends, space).select(F.col("node").alias("component"), F.col("component").alias("into"))
        labels = _grown(labels, merged)
    out = rows_of
    if labels is not None:
        out = out.join(labels, "node", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _round(active: DataFrame, turn: int, slots: int, sets: DataFrame, percent: int, space: Workspace, refine: bool) -> tuple[DataFrame, DataFrame]:
    """One round of centres, at most `slots` in a key: what is left in the keys (and, to refine them, in finer ones), and links (a, b: components)."""
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(slots))
    # Classes in many keys come first, so that many keys have the same centre and their members are compared once.
    keys = active.groupBy("node", "s1").agg(F.count("*").alias("keys"))
    order = F.struct((-F.col("keys")).alias("keys"), (F.col("n") - F.col("common")).alias("own"), F.col("node"), F.col("s1"), F.col("component"))
    centres = active.join(keys, ["node", "s1"]).groupBy("key", slot.alias("slot")).agg(F.min(order).alias("c")).select("key", F.col("c.node").alias("c_node"), F.col("c.s1").alias("c_s1"), F.col("c.component").alias("c_component"))
    centres = space.save(centres, "centres")
    apart_from = (F.col("node") != F.col("c_node")) | (F.col("s1") != F.col("c_s1"))
    apart = apart_from if refine else F.col("component") != F.col("c_component")
    # Where the centre leaves one component behind, the key is done without anybody's differences.
    others = active.join(centres.select("key", "c_node", "c_s1"), "key").where(apart_from).groupBy("key").agg((F.min("component") < F.max("component")).alias("more"))
    meeting = F.max("more") if refine else F.lit(False)
    spokes = active.join(centres.join(others, "key") if refine else centres, "key").where(apart)
    spokes = spokes.groupBy("c_node", "c_s1", "c_component", "node", "s1", "n", "common", "component").agg(meeting.alias("meeting"))
    stars = space.save(_compare(space.save(spokes, "spokes"), sets, refine), "stars")
    found = stars.where(_linked(percent) & (F.col("component") != F.col("c_component"))).select(F.col("c_component").alias("a"), F.col("component").alias("b"))
    settled = centres.select("key", F.col("c_node").alias("node"), F.col("c_s1").alias("s1"))
    if refine:
        near = stars.where(_linked(_settled(percent))).select("c_node", "c_s1", "node", "s1")
        placed = active.join(centres.select("key", "c_node", "c_s1"), "key")
        settled = settled.unionByName(placed.join(near, ["c_node", "c_s1", "node", "s1"], "left_semi").select("key", "node", "s1"))
    left = active.join(settled, ["key", "node", "s1"], "left_anti").select(*MEMBER)
    if refine:
        left = left.unionByName(_refined(stars, percent, turn, space))
    return left, space.save(found.distinct(), "links")


def _relabel(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with each component replaced by the one that it went into."""
    return rows.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into").select(rows.columns)


def _grown(labels: DataFrame | None, merged: DataFrame) -> DataFrame:
    """(node, component) after components were merged; a component is named by its smallest node."""
    fresh = merged.select(F.col("component").alias("node"), F.col("into").alias("component"))
    if labels is None:
        return fresh
    return _relabel(labels, merged).unionByName(fresh.join(labels.select("node"), "node", "left_anti"))
