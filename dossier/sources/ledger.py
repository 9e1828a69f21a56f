"""A written record of what was asked and answered, so that every request of an attempt is asked once.

A model's answer differs from call to call, so nothing may depend on a plan that calls again. Answers of an attempt are appended to one
folder of the ledger, slice by slice, and everything else reads them from there. A run that begins again with the same ledger asks only what
has no answer yet; what a crash can lose are the answers of the slice that was being written.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder

#: What names a request.
REQUEST = ["key", "field", "chunk"]


@dataclass(frozen=True)
class Progress:
    """How far a run is, told by the writes themselves."""

    done: int
    failed: int
    seconds: float
    total: int | None = None

    def plus(self, done: int, failed: int, seconds: float) -> Progress:
        return Progress(self.done + done, self.failed + failed, self.seconds + seconds, self.total)

    @property
    def rate(self) -> float | None:
        """Rows a second; None before there is anything to tell from."""
        return self.done / self.seconds if self.done and self.seconds > 0 else None

    @property
    def seconds_left(self) -> float | None:
        return None if self.total is None or self.rate is None else max(self.total - self.done, 0) / self.rate

    @property
    def percent(self) -> float | None:
        return None if self.total is None else 100.0 if not self.total else round(100 * self.done / self.total, 1)


def write_observed(df: DataFrame, path: str, failed: Column, mode: str = "append") -> tuple[int, int, float]:
    """Write df as Parquet; rows written, rows among them that failed, and seconds, without a second scan."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("done"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"))
    began = time.monotonic()
    observed.write.mode(mode).parquet(path)
    return seen.get["done"], seen.get["failed"], time.monotonic() - began


def same_request(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Join of a with b's requests; nulls in a name are a name."""
    names = b.select(*[F.col(c).alias(f"__{c}") for c in REQUEST]).distinct()
    on = None
    for c in REQUEST:
        one = a[c].eqNullSafe(names[f"__{c}"])
        on = one if on is None else on & one
    return a.join(names, on, kind)


class Ledger:
    """Answers by attempt below one folder; without a path it is new and lasts as long as the program."""

    def __init__(self, spark: SparkSession, path: str | None = None, slices: int = 1, report: Callable[[int, Progress], None] | None = None):
        self.spark, self.slices, self.report = spark, slices, report
        self.path = path.rstrip("/") if path else shared_folder(spark, "ledger")

    def folder(self, attempt: int) -> str:
        return f"{self.path}/attempt-{attempt:03d}"

    def answers(self, attempt: int, schema) -> DataFrame | None:
        """What is written of an attempt."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(attempt))
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return None
        return self.spark.read.schema(schema).parquet(self.folder(attempt))

    def ask(self, requests: DataFrame, attempt: int, answer: Callable[[DataFrame, int], DataFrame], failed: Column) -> DataFrame:
        """Answers to the requests, of which only those without one are asked. Each slice of them, by hash of the request, is one write."""
        schema = answer(requests, attempt).schema
        before = self.answers(attempt, schema)
        pending = requests if before is None else same_request(requests, before, "left_anti")
        progress = Progress(0, 0, 0.0, pending.count() if self.report else None)
        bucket = F.pmod(F.xxhash64(*REQUEST), F.lit(self.slices))
        for n in range(self.slices):
            part = pending if self.slices == 1 else pending.where(bucket == n)
            if before is None or not part.isEmpty():
                progress = progress.plus(*write_observed(answer(part, attempt), self.folder(attempt), failed))
                if self.report:
                    self.report(attempt, progress)
        return same_request(self.answers(attempt, schema), requests, "left_semi")
