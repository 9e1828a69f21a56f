"""Incremental ingest: new files become records as they arrive, at least once, and a restart goes on where the last run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import FILE_SCHEMA, Decoder, decode, keyed


def file_stream(spark: SparkSession, root: str, suffix: str = "pdf", files_per_batch: int = 1000) -> DataFrame:
    """Files below root as a stream; the checkpoint of the query remembers which ones it has seen."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    return keyed(files, root)


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, decoder: Decoder, transform: Callable[[DataFrame], DataFrame] | None = None, suffix: str = "pdf", files_per_batch: int = 1000):
    """Run once over all that is new: decode, transform and append each batch below `out`, one folder a batch.

    A batch that is repeated after a crash overwrites its own folder, so each file's records appear exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        records = decode(batch, decoder)
        if transform:
            records = transform(records)
        records.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = file_stream(spark, root, suffix, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """All records; the last batch wins where a key was ingested again."""
    from ..operators.matching import keep_last

    return keep_last(spark.read.parquet(out), ["key"], ["batch"])
