"""Line dedup against levelled sorted runs of line hashes. DataFrame operations only.

The texts are read once: every line key's hash goes into one table, by batches of ascending doc_id. A run is a table (h1, h2, owner),
one row for each key that was new in its batch, bucketed by the hash and sorted in each bucket. A batch's distinct keys
are anti-joined with every run in turn, one left merge join a run that also tells who had the key before; what no run
has becomes the batch's own run at level 0. Runs are read in the order in which they are stored, so these joins neither shuffle nor
sort them (a test looks at the plan). When a level holds `fanout` runs they are merged into one run of the next level, so there are
logarithmically many runs. A run has one file for each bucket, also a merged one, and as many buckets as the lines fill, so there are no
more files and tasks than these need.

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends and with A-Z lower-cased, as 128 bits of hash. Keys of at
least `min_chars` code points that several documents hold stay only in the smallest doc_id. Very common lines meet in
map-side aggregation first; the join that finds what to drop has one row for each key on one side, so a hot key can be split.

Nulls and empty texts are one empty line. Rows without doc_id count as one last document. Rows that share a doc_id are one
document whose lines are all its own, and come back one for one. Texts of any length are split whole. An empty table gives an empty table. All columns of the input come back
with their values, whatever their names; internal columns take names that the input doesn't have.
"""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, let_go, parallelism, settings, unused

BLANKS = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1
#: Without it Spark forgets that a bucket's only file is sorted. It holds while runs are read, not beyond.
ORDERED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
#: Lines of a batch for each bucket of its run.
BUCKET_ROWS = 1 << 16


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


class LineRuns:
    """Levelled runs below a workspace's folder, as bucketed and sorted tables; leaving the block drops them from the catalogue."""

    def __init__(self, spark: SparkSession, space: Workspace, fanout: int, buckets: int):
        self.spark, self.space, self.fanout, self.buckets = spark, space, fanout, buckets
        self.levels: list[list[str]] = []
        self.prefix = f"line_run_{uuid.uuid4().hex}"
        self.names: list[str] = []

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, rows: DataFrame) -> str:
        """rows are dealt by the number of their bucket, so each bucket is one file. Dealt by (h1, h2), merged runs would not be shuffled: Spark takes their buckets for dealt already."""
        name = f"{self.prefix}_{len(self.names)}"
        self.names.append(name)
        rows.repartitionById(self.buckets, F.pmod(F.hash("h1", "h2"), F.lit(self.buckets))).write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self.space.path("run")).saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def look_up(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ...) with `had`: the owner of each in whichever run has it."""
        out = keys.withColumn("had", F.lit(None).cast("long"))
        for run in self.tables():
            out = out.join(run.withColumnRenamed("owner", "found"), ["h1", "h2"], "left").withColumn("had", F.coalesce("had", "found")).drop("found")
        return out

    def add(self, rows: DataFrame) -> None:
        """Add a run, then merge the runs of every level that is full."""
        level, new = 0, self._write(rows)
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            merged, self.levels[level] = self.levels[level], []
            union = self.spark.table(merged[0])
            for name in merged[1:]:
                union = union.unionByName(self.spark.table(name))
            new = self._write(union)
            for name in merged:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1


def _bounds(ids: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about equal numbers of rows."""
    cuts = ids.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    return sorted(set(cuts or []))


def _repeated_lines(rows: DataFrame, space: Workspace, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """rows: (id, row, text). (row, pos) of every line that a smaller id has."""
    spark = rows.sparkSession
    cuts = _bounds(rows.select("id"), batches)
    batch = sum(((F.col("id") > cut).cast("int") for cut in cuts), F.lit(0))
    lines = rows.select("id", "row", batch.alias("batch"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("id", "row", "batch", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = space.save(keyed.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "batch"), "lines", by="batch")
    buckets = min(parallelism(spark), 1 + hashed.count() // ((len(cuts) + 1) * BUCKET_ROWS))
    dropped = None
    with LineRuns(spark, space, fanout, buckets) as runs, settings(spark, ORDERED | {"spark.sql.shuffle.partitions": str(buckets)}):
        for b in range(len(cuts) + 1):
            own = hashed.where(F.col("batch") == b).drop("batch")
            keys = own.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
            looked = space.save(runs.look_up(keys), "looked-up")
            repeated = looked.where("had is not null or lo < hi").select("h1", "h2", F.coalesce("had", "lo").alias("owner"))
            lost = own.join(repeated, ["h1", "h2"]).where("id <> owner")
            part = space.save(lost.select("row", "pos").distinct(), "dropped")
            dropped = part if dropped is None else dropped.unionByName(part)
            if b < len(cuts):
                runs.add(looked.where("had is null").select("h1", "h2", F.col("lo").alias("owner")))
            space.drop(looked)
            let_go(spark)
    space.drop(hashed)
    return dropped


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with the text reduced to its kept lines, and __n_lines (before dropping) and __n_dropped."""
    space = Workspace(docs.sparkSession, "lines")
    id_, text = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(id_.alias("id"), F.xxhash64(id_, text).alias("row"), text.alias("text"))
    row, drop, lines = (unused(docs, name) for name in ("row", "drop", "lines"))
    gone = _repeated_lines(rows, space, min_chars, batches, fanout).groupBy(F.col("row").alias(row)).agg(F.collect_list("pos").alias(drop))
    out = docs.withColumns({row: F.xxhash64(id_, text), lines: F.split(text, "\n")}).join(gone, row, "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(drop), F.array().cast("array<int>")))
    kept = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return out.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias(unused(docs, "__n_lines")),
        F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long").alias(unused(docs, "__n_dropped")),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), d AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND o.owner <> k.doc_id AS dropped FROM k LEFT JOIN o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
