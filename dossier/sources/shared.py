"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


_made: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='dossier-')}"
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@atexit.register
def _clear() -> None:
    """Delete what this program wrote there; results that are not written elsewhere by then are gone."""
    gateway = SparkContext._gateway
    for folder in _made if gateway is not None else ():
        where = gateway.jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once in the shared folder and read again: its lineage ends here, and what it reads survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows numbered from 1 in a total order, without bringing them into one task.

    Rows are sorted by ranges and written with a number within their range; the ranges' sizes, a row for each partition, give the offsets.
    """
    rows = written(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("__place", 33).alias("__part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.withColumn("__part", part).join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__place", "__before")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, fold, before: bool = False) -> DataFrame:
    """df with `fold` (F.sum or F.max) of a column over each key's rows up to this one (without it: `before`), in a total order, without a key's rows in one task.

    Rows are sorted by ranges of (keys, order) and written. Within a range a window folds each key's part of it; what lies before
    comes from one row for each key and range, folded over the ranges.
    """
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__place", F.monotonically_increasing_id())
    rows = written(rows, "running")
    rows = rows.withColumn("__part", F.shiftrightunsigned("__place", 33))
    here = W.partitionBy(*keys, "__part").orderBy("__place").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    parts = rows.groupBy(*keys, "__part").agg(fold(value).alias("__all"))
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.withColumn("__before", fold("__all").over(earlier))
    carried = carried.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__part").alias("__p"), "__before")
    same = F.col("__part") == F.col("__p")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    both = rows.withColumn("__here", fold(value).over(here)).join(carried, same, "left")
    total = F.greatest("__before", "__here") if fold is F.max else F.coalesce("__before", F.lit(0)) + F.coalesce("__here", F.lit(0))
    return both.withColumn(name, total).drop("__here", "__before", "__part", "__place", "__p", *[f"__k{n}" for n in range(len(keys))])


def running_sums(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return running(df, keys, order, value, name, F.sum)
