"""Bootstrap intervals: resamples with replacement, drawn by a counter-based generator.

Draw i of resample b is a hash of (seed, b, i), so any task can make any draw, in any order, again after a lost executor, and any engine can repeat it.
A statistic needs only sums of counts, so rows with equal counts are one kind, counted with map-side aggregation, and a draw picks a
rank among the rows, which names its kind. Tasks get (resample, block of draws) and give back sums by resample: there is never
a row for a draw, and what is broadcast are the kinds, at most MOST_KINDS of them (more is an error, not a sample).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of rows that are broadcast at most, draws of one task row.
MOST_KINDS, BLOCK = 1 << 16, 1 << 16
_LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 32-bit numbers; products stay below 2**63, for engines with signed integers."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        x = x ^ (x >> np.uint64(shift))
        x = (x * np.uint64(factor)) & _LOW
    return x ^ (x >> np.uint64(15))


def words(seed: int, lane: int, b: np.ndarray, i: np.ndarray) -> np.ndarray:
    """32-bit words of draws i of resamples b; each resample has a key of two words."""
    start = mixed(np.array([(seed + lane * 0x9E3779B9) & 0xFFFFFFFF], dtype=np.uint64))
    key = mixed(np.asarray(b).astype(np.uint64) ^ start)
    further = mixed(key ^ np.uint64(0x9E3779B9))
    return mixed(mixed(np.asarray(i).astype(np.uint64) ^ key) ^ further)


def ranks(seed: int, b: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """Which of n rows the draws take: 64 random bits times n, the integer part."""
    high, low, size = words(seed, 0, b, i), words(seed, 1, b, i), np.uint64(n)
    return (high * size + ((low * size) >> np.uint64(32))) >> np.uint64(32)


def kinds_of(df: DataFrame, counts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of counts in ascending order (nulls are 0), and how many rows have each."""
    rows = df.groupBy(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts]).agg(F.count("*").alias("__n")).limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} different rows of counts")
    rows = sorted(tuple(r) for r in rows)
    table = np.array(rows, dtype=np.int64).reshape(len(rows), len(counts) + 1)
    return table[:, :-1], table[:, -1]


def bootstrap(df: DataFrame, counts: list[str], statistic: Column, b: int, seed: int) -> DataFrame:
    """(b, value) of `statistic`, an expression over sums of the counts, for `b` resamples of the rows of df. No rows: no resamples."""
    spark = df.sparkSession
    kinds, sizes = kinds_of(df, counts)
    n = int(sizes.sum())
    if n >= 1 << 31:
        raise ValueError("at most 2**31 - 1 rows can be resampled")
    ends, per = np.cumsum(sizes), max(BLOCK, 1)
    shared = spark.sparkContext.broadcast((kinds, ends))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds, ends = shared.value
        for batch in batches:
            sums = np.zeros((len(batch), len(counts)), dtype=np.int64)
            for at, (resample, first) in enumerate(zip(batch["b"].tolist(), batch["first"].tolist())):
                i = np.arange(first, min(first + per, n))
                taken = np.bincount(np.searchsorted(ends, ranks(seed, resample, i, n).astype(np.int64), side="right"), minlength=len(ends))
                sums[at] = taken @ kinds
            yield pd.DataFrame({"b": batch["b"], **{c: sums[:, k] for k, c in enumerate(counts)}})

    blocks = -(-n // per)
    tasks = spark.range(b * blocks, numPartitions=max(1, min(b * blocks, 2 * spark.sparkContext.defaultParallelism)))
    tasks = tasks.select(F.expr(f"id div {max(blocks, 1)}").alias("b"), (F.col("id") % max(blocks, 1) * per).alias("first"))
    sums = tasks.mapInPandas(draw, "b long, " + ", ".join(f"`{c}` long" for c in counts)).groupBy("b").agg(*[F.sum(c).alias(c) for c in counts])
    return sums.select("b", statistic.alias("value"))


def percentile_interval(samples: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return samples.agg(F.count("*").alias("b"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.get(q, F.lit(0)), 6).alias("lo"), F.round(F.get(q, F.lit(1)), 6).alias("hi"))
