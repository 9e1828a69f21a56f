"""Record files: resumable JSON lines, ordered exports, per-field tables, atomic rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog as C
from ..functions.text import failed

CORRUPT = "_corrupt"


def record_schema(columns: list[str]) -> T.StructType:
    return T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField(CORRUPT, T.StringType())])


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped, broken ones (such as a line that a crash cut) keep their text in `_corrupt`."""
    return spark.read.schema(record_schema(columns or C.record_order())).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def parse_records(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The same for lines that are already a table with a column `value`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.where(F.trim("value") != "").select(F.from_json("value", record_schema(columns or C.record_order()), options).alias("r")).select("r.*")


def split_bad(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and the broken lines for counting."""
    return records.where(F.col(CORRUPT).isNull()).drop(CORRUPT), records.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def pending(entries: DataFrame, records: DataFrame, key: str = "key", record_key: str = "Source Path", retry: bool = False, brand: str = "Brand Name", limit: int | None = None) -> DataFrame:
    """Entries without a record, in key order; with retry, records that failed don't count. The limit comes after pruning."""
    done = records.where(~failed(F.col(f"`{brand}`"))) if retry else records
    left = entries.join(done.select(F.col(f"`{record_key}`").alias(key)), key, "left_anti")
    return left.orderBy(key).limit(limit) if limit is not None else left


def ordered(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Documented columns that are there, in the documented order; others are left out."""
    return df.select(*[F.col(f"`{c}`") for c in (order or C.record_order()) if c in df.columns])


def reshape(df: DataFrame, drop: tuple[str, ...] = (), rename: dict[str, str] | None = None, insert: dict[int, tuple[str, Column]] | None = None) -> DataFrame:
    """df without some columns (those that aren't there are no error), others renamed, and new ones at the given places, lowest first."""
    names = rename or {}
    out = [F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns if c not in drop]
    for place in sorted(insert or {}):
        name, value = insert[place]
        out.insert(place, value.alias(name))
    return df.select(*out)


def append_records(df: DataFrame, path: str) -> None:
    """Add records; a file is visible only when its task has committed."""
    df.write.mode("append").json(path)


def rewrite_records(df: DataFrame, path: str) -> None:
    """Replace the records at path: written beside it, then swapped by two renames, so that a crash leaves one whole version."""
    spark = df.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target, fresh, old = Path(path), Path(path.rstrip("/") + ".new"), Path(path.rstrip("/") + ".old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").json(fresh.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def write_field_tables(df: DataFrame, root: str, headers: dict[str, str] | None = None) -> list[str]:
    """One table of (ID, field) for each field, as CSV; headers may differ from the record's."""
    out = []
    for f in C.RECORD_FIELDS:
        if f.kind == "key" or f.record not in df.columns:
            continue
        path = f"{root}/{f.name}"
        write_csv(df.select("ID", F.col(f"`{f.record}`").alias((headers or {}).get(f.record, f.evaluation or f.record))), path)
        out.append(path)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Values as they are: blanks at their ends and line breaks within them are kept."""
    df.write.mode(mode).csv(path, header=True, quoteAll=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Always with a schema: identification numbers have leading zeros."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def write_json(df: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """One JSON document, an array of the rows, as one file; for tables of a checked number of rows, such as memos and summaries."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows for one JSON document; write JSON lines")
    rows = df.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("rows"))
    rows.select(F.to_json("rows", {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_excel(df: DataFrame, path: str, limit: int = 1_048_575) -> None:
    """A workbook needs openpyxl and one machine: only for tables within a sheet's row limit, which is checked."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError("too many rows for a sheet; write CSV or Parquet")
    pdf = ordered(df).toPandas()
    if len(pdf):
        import os

        pdf.to_excel(path + ".tmp.xlsx", index=False)
        os.replace(path + ".tmp.xlsx", path)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """Through pandas, which needs openpyxl."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str))
