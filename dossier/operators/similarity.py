"""Similarities of two sides' vectors within blocks, by tiles: no pair below the threshold is ever a row.

Each side is sorted in ranges of (block, norm) and cut into tiles of at most TILE vectors of about the same length. Tiles meet by an equi-join on the
block, and only those whose largest norms' product reaches the threshold: no pair of the others can (Cauchy and Schwarz).
A pair of tiles is one matrix product; what comes near the threshold is summed again in the order of the elements, so
sums are those of a fold over the elements. The right side's tiles are dealt over SPREAD groups and the left side's are in each of them,
so a block with all rows is not one task. Null blocks and vectors, vectors with null elements or of different lengths have no similarity.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

TILE, SPREAD, MARGIN = 256, 8, 1e-7
#: Vectors of a tile where few pairs of a product are wanted.
WIDE = 1024
#: Bits of a similarity that its level leaves off: 4,096 levels for each power of two.
FINE = np.int64(40)
#: Similarities that a task gathers before it counts them by level, and levels that it holds.
GATHERED, HELD = 1 << 18, 1 << 17


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tiles(df: DataFrame, block: str, item: str, vec: str, most: int | None = None) -> DataFrame:
    """(block, size, norm, items, vectors): vectors as doubles, row after row; at most TILE of them, or `most`."""
    v = F.col(vec).cast("array<double>")
    rows = df.select(F.col(block).alias("block"), F.col(item).alias("item"), v.alias("vec"), F.sqrt(dot(v, v)).alias("norm")).where("block is not null and norm is not null")
    rows = rows.repartitionByRange("block", "norm").sortWithinPartitions("block", "norm", "item")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([
        T.StructField("block", kinds["block"]), T.StructField("size", T.IntegerType()), T.StructField("norm", T.DoubleType()),
        T.StructField("items", T.ArrayType(kinds["item"])), T.StructField("vectors", T.BinaryType()),
    ])
    arrow = pa.schema([("size", pa.int32()), ("norm", pa.float64()), ("vectors", pa.binary())])

    most = most or TILE

    def cut(batches):
        key, held = None, []

        def tile():
            block, items = pa.concat_arrays([h[0].slice(0, 1) for h in held[:1]]), pa.concat_arrays([h[1] for h in held])
            data = b"".join(np.array(h[2], dtype=np.float64).tobytes() for h in held)
            made = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
            rest = [pa.array([v], t) for v, t in zip((key[1], held[-1][3], data), arrow.types)]
            return pa.RecordBatch.from_arrays([block, rest[0], rest[1], made, rest[2]], names=schema.names)

        for batch in batches:
            blocks, vecs, norms = batch.column("block").to_pylist(), batch.column("vec").to_pylist(), batch.column("norm").to_pylist()
            for n, (b, x, norm) in enumerate(zip(blocks, vecs, norms)):
                if held and (len(held) >= most or (b, len(x)) != key):
                    yield tile()
                    held = []
                key = (b, len(x))
                held.append((batch.column("block").slice(n, 1), batch.column("item").slice(n, 1), x, norm))
        if held:
            yield tile()

    return written(rows.mapInArrow(cut, schema), "tiles")


def _meet(left: DataFrame, right: DataFrame, threshold: float | Column | None) -> DataFrame:
    a = left.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.pmod(F.xxhash64("vectors"), F.lit(SPREAD)).cast("int").alias("r_group"))
    on = (F.col("block") == F.col("r_block")) & (F.col("group") == F.col("r_group")) & (F.col("size") == F.col("r_size"))
    if threshold is not None:
        on = on & (F.col("norm") * F.col("r_norm") >= threshold - MARGIN)
    return a.join(b, on)


def _near(batch: pa.RecordBatch, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row n is a pair of tiles. Places on both sides and sums of the pairs that come near the threshold."""
    size = batch.column("size")[n].as_py()
    a, b = (np.frombuffer(batch.column(c)[n].as_py(), dtype=np.float64).reshape(len(batch.column(i)[n]), size) for c, i in (("vectors", "items"), ("r_vectors", "r_items")))
    scale = batch.column("norm")[n].as_py() * batch.column("r_norm")[n].as_py()
    i, j = np.nonzero(a @ b.T >= threshold - MARGIN * max(scale, 1.0))
    total = np.zeros(len(i))
    for k in range(size):
        total = total + a[i, k] * b[j, k]
    return i, j, total


def similar_pairs(left: DataFrame, right: DataFrame, block: str, left_item: str, right_item: str, left_vec: str, right_vec: str, threshold: float) -> DataFrame:
    """(block, left_item, right_item, sim) of all pairs of a block with a similarity, rounded to 9 digits, of at least the threshold."""
    a, b = tiles(left, block, left_item, left_vec), tiles(right, block, right_item, right_vec)
    return pairs_above(a.withColumn("cut", F.lit(float(threshold))), b, block, left_item, right_item)


def pairs_above(a: DataFrame, b: DataFrame, block: str, left_item: str, right_item: str) -> DataFrame:
    """(block, left_item, right_item, sim) of all pairs of the tiles with a rounded similarity of at least the cut that the left tile has."""
    met = _meet(a, b, F.col("cut"))
    schema = T.StructType([
        T.StructField(block, a.schema["block"].dataType), T.StructField(left_item, a.schema["items"].dataType.elementType), T.StructField(right_item, b.schema["items"].dataType.elementType),
        T.StructField("raw", T.DoubleType()), T.StructField("__cut", T.DoubleType()),
    ])

    def work(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                cut = batch.column("cut")[n].as_py()
                i, j, total = _near(batch, n, cut)
                if len(i):
                    blocks = batch.column("block").take(pa.array(np.full(len(i), n)))
                    columns = [blocks, batch.column("items")[n].values.take(pa.array(i)), batch.column("r_items")[n].values.take(pa.array(j)), pa.array(total), pa.array(np.full(len(i), cut))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    sim = F.round("raw", 9)
    return met.mapInArrow(work, schema).select(block, left_item, right_item, sim.alias("sim"), "__cut").where(F.col("sim") >= F.col("__cut")).drop("__cut")


def _levels(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, equal for values that differ in the last bits only."""
    bits = np.ascontiguousarray(values, dtype=np.float64).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> FINE


def _least(levels: np.ndarray) -> np.ndarray:
    """The least value of each level."""
    keys = levels << FINE
    return (keys ^ ((keys >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _summed(levels: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the counts of each level, without the levels above which there are already more than `most`."""
    levels, at = np.unique(levels, return_inverse=True)
    sums = np.zeros(len(levels), dtype=np.int64)
    np.add.at(sums, at, counts)
    above = sums[::-1].cumsum()[::-1] - sums
    return levels[above <= most], sums[above <= most]


def cuts(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(block, cut): the lowest similarity of each block, the threshold at least, from which at most as many pairs are found as the left tiles' column `most` says.

    Where the topmost pairs alone are more, it is a cut that these reach. Blocks without pairs from the threshold on have no row. Pairs are counted by
    level; a task leaves off the levels below `most` pairs of its own, so that it looks closely at few of them.
    """
    met = _meet(a, b, threshold)
    schema = T.StructType([T.StructField("block", a.schema["block"].dataType), T.StructField("most", T.LongType()), T.StructField("least", T.DoubleType()), T.StructField("pairs", T.LongType())])

    def work(batches):
        found, waiting, type_ = {}, {}, None

        def count(block):
            levels, counts, most, _ = found[block]
            more = _levels(np.concatenate(waiting.pop(block)))
            levels, counts = _summed(np.concatenate([levels, more]), np.concatenate([counts, np.ones(len(more), dtype=np.int64)]), most)
            found[block] = (levels, counts, most, _least(levels[:1])[0] if counts.sum() > most else -np.inf)

        def given():
            for block in list(waiting):
                count(block)
            for block, (levels, counts, most, _) in found.items():
                columns = [pa.array([block] * len(levels), type_), pa.array(np.full(len(levels), most)), pa.array(_least(levels)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            found.clear()

        gathered = 0
        for batch in batches:
            type_ = batch.column("block").type
            for n in range(batch.num_rows):
                block, size = batch.column("block")[n].as_py(), batch.column("size")[n].as_py()
                x, y = (np.frombuffer(batch.column(c)[n].as_py(), dtype=np.float64).reshape(len(batch.column(i)[n]), size) for c, i in (("vectors", "items"), ("r_vectors", "r_items")))
                margin = MARGIN * max(batch.column("norm")[n].as_py() * batch.column("r_norm")[n].as_py(), 1.0)
                if block not in found:
                    found[block] = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), batch.column("most")[n].as_py(), -np.inf)
                sums = x @ y.T
                # Less a margin, so that the sum in order, rounded, is in the level or above it.
                near = sums[sums >= max(threshold - margin, found[block][3])] - margin
                if len(near):
                    waiting.setdefault(block, []).append(near)
                    gathered += len(near)
                if gathered > GATHERED:
                    gathered = 0
                    for block in list(waiting):
                        count(block)
                    if sum(len(f[0]) for f in found.values()) > HELD:
                        yield from given()
        yield from given()

    counted = met.mapInArrow(work, schema).groupBy("block", "most", "least").agg(F.sum("pairs").alias("pairs"))
    down = counted.withColumn("down", F.sum("pairs").over(W.partitionBy("block").orderBy(F.desc("least"))))
    fitting = F.min(F.when(F.col("down") <= F.col("most"), F.col("least")))
    found = down.groupBy("block").agg(F.when(F.max("down") <= F.first("most"), F.lit(float(threshold))).otherwise(F.coalesce(fitting, F.max("least"))).alias("cut"))
    return found.select("block", F.greatest("cut", F.lit(float(threshold))).alias("cut"))


def nearest(left: DataFrame, right: DataFrame, block: str, item: str, left_vec: str, right_vec: str, threshold: float) -> DataFrame:
    """(block, item, sim): the greatest similarity that each left item has in its block, where it reaches the threshold."""
    a, b = tiles(left, block, item, left_vec), tiles(right.withColumn("__i", F.lit(0)), block, "__i", right_vec)
    schema = T.StructType([T.StructField(block, a.schema["block"].dataType), T.StructField(item, a.schema["items"].dataType.elementType), T.StructField("raw", T.DoubleType())])

    def work(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                i, _, total = _near(batch, n, threshold)
                if len(i):
                    best = np.full(i.max() + 1, -np.inf)
                    np.maximum.at(best, i, total)
                    found = np.unique(i)
                    yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(np.full(len(found), n))), batch.column("items")[n].values.take(pa.array(found)), pa.array(best[found])], names=schema.names)

    best = _meet(a, b, threshold).mapInArrow(work, schema).groupBy(block, item).agg(F.round(F.max("raw"), 9).alias("sim"))
    return best.where(F.col("sim") >= threshold)


def threshold_counts(left: DataFrame, right: DataFrame, block: str, left_vec: str, right_vec: str, thresholds: list[float]) -> DataFrame:
    """(threshold, pairs): how many pairs reach each threshold, one pass for all of them; each task gives back a row for each."""
    none = F.lit(0).alias("__i")
    a, b = (tiles(df.select(block, v, none), block, "__i", v) for df, v in ((left, left_vec), (right, right_vec)))
    least = min(thresholds)

    def work(batches):
        counts = np.zeros(len(thresholds), dtype=np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                total = np.round(_near(batch, n, least)[2], 9)
                counts += [(total >= t).sum() for t in thresholds]
        yield pa.RecordBatch.from_arrays([pa.array(thresholds, pa.float64()), pa.array(counts)], names=["threshold", "pairs"])

    counted = _meet(a, b, least).mapInArrow(work, "threshold double, pairs long").groupBy("threshold").agg(F.sum("pairs").alias("pairs"))
    levels = left.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return levels.join(counted, "threshold", "left").select("threshold", F.coalesce("pairs", F.lit(0)).alias("pairs"))
