"""A data source of corpus files by page: `spark.read.format("paged_files")`.

Rows are (key, page_num, text, error). Files are listed once and dealt to partitions by their bytes. Only the pages that are asked for are decoded: by the options
`first_page` and `last_page`, and by filters on page_num where `push_filters` says that the session pushes filters to Python sources
(spark.sql.python.filterPushdown.enabled; read_pages looks). A file that can't be decoded is one row with its error and no page; pages without text are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .files import DECODERS

#: Bytes of a partition, unless the option `partition_bytes` says otherwise.
PARTITION_BYTES, LAST = 32 << 20, 2**31 - 1


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.suffix, self.decoder = options.get("suffix", "pdf").lower(), options.get("decoder", "pdf")
        self.first, self.last = int(options.get("first_page", 1)), int(options.get("last_page", LAST))
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        found = sorted((x.path, x.size) for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith("." + self.suffix))
        out: list[list[str]] = [[]]
        held = 0
        for path, size in found:
            if out[-1] and held + size > self.size:
                out.append([])
                held = 0
            out[-1].append(path)
            held += size
        return [Files(p) for p in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        decoder = DECODERS[self.decoder]()
        wanted = range(self.first, self.last + 1)
        for path in partition.paths:
            key = path[len(base) :].lstrip("/")
            try:
                with system.open_input_stream(path) as f:
                    content = f.read()
                rows = [(key, n, text, None) for n, text in decoder.pages(content, wanted) if text.strip()]
            except Exception as e:
                rows = [(key, None, None, f"{type(e).__name__}: {e}"[:200])]
            yield from rows


class PushingReader(PagedReader):
    """For sessions that push filters; others refuse a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow the range of pages. All filters go back to Spark, which knows best about nulls."""
        for f in filters:
            if getattr(f, "attribute", None) == ("page_num",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            yield f


class PagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return "key string, page_num int, text string, error string"

    def reader(self, schema) -> PagedReader:
        return (PushingReader if self.options.get("push_filters", "false") == "true" else PagedReader)(self.options)


def read_pages(spark: SparkSession, root: str, suffix: str = "pdf", decoder: str = "pdf", first: int = 1, last: int = LAST, **options) -> DataFrame:
    """Pages first to last of all files below root, and a row for each broken file."""
    spark.dataSource.register(PagedFiles)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("paged_files").options(suffix=suffix, decoder=decoder, first_page=first, last_page=last, push_filters=pushes, **options)
    return reader.load(root).where(F.col("page_num").isNull() | F.col("page_num").between(first, last))
