"""Shared storage for intermediate tables, and small helpers that all operators use."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Bounds of the Arrow batches that are sent to Python while a table is written, and of the slices that operators work on.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 1024, 4 << 20, 1 << 19

_roots: list[str] = []
_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='dossier-')}")
    return _own[0]


@atexit.register
def _clear() -> None:
    """Delete what this program's operators wrote; results that are not written elsewhere by then are gone."""
    gateway = SparkContext._gateway
    for root in _roots if gateway is not None else ():
        where = gateway.jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold only inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """Tables written below the shared folder to cut lineage; each operator call has its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _roots.append(self.root)
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df once (partitioned by a column, if one is given) and return a scan of what was written, so that later stages never recompute it."""
        path = self.path(name)
        with settings(self.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
            writer = df.write.partitionBy(by) if by else df.write
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_at = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        path = getattr(df, "_saved_at", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of stages whose result has been written, as it does when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, also not in other case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes in the text column, one row at least; memory that this freed goes back to the system at the end.

    Workers stay alive between tasks, so what they keep would add up beside the JVM.
    """
    try:
        for batch in batches:
            start, total = 0, 0
            for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
                if i > start and total + size > most:
                    yield batch.slice(start, i - start)
                    start, total = i, 0
                total += size
            if batch.num_rows > start:
                yield batch.slice(start)
    finally:
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
