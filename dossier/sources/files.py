"""Corpus files: discovery, decoding into pages and outlines with a pluggable decoder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PAGES_SCHEMA = "array<struct<page_num:int,text:string>>"
OUTLINE_SCHEMA = "array<struct<depth:int,title:string,page:int>>"


class Decoder(Protocol):
    """Turns the bytes of a file into page texts (by number from 1; only those that are wanted, if that is said) and a nested outline of (title, page) and lists."""

    def pages(self, content: bytes, wanted: range | None = None) -> list[tuple[int, str]]: ...

    def outline(self, content: bytes) -> list: ...


class TextDecoder:
    """Plain text; pages are divided by form feeds. Lines that start with `#` marks are outline entries."""

    errors = "replace"

    def pages(self, content: bytes, wanted: range | None = None) -> list[tuple[int, str]]:
        parts = content.split(b"\f", -1 if wanted is None else min(max(wanted.stop - 1, 0), len(content)))
        return [(n, t.decode("utf-8", self.errors)) for n, t in enumerate(parts, 1) if wanted is None or n in wanted]

    def outline(self, content: bytes) -> list:
        out: list = []
        for n, text in self.pages(content):
            for line in text.split("\n"):
                if line.startswith("#"):
                    depth = len(line) - len(line.lstrip("#"))
                    level = out
                    for _ in range(depth - 1):
                        if not level or not isinstance(level[-1], list):
                            level.append([])
                        level = level[-1]
                    level.append((line.lstrip("# "), n))
        return out


class StrictTextDecoder(TextDecoder):
    """Plain text; a page that isn't UTF-8 is an error."""

    errors = "strict"


class PdfDecoder:
    """PDF files, through PyPDF2 where it is installed."""

    def _reader(self, content: bytes):
        import io

        from PyPDF2 import PdfReader

        return PdfReader(io.BytesIO(content))

    def pages(self, content: bytes, wanted: range | None = None) -> list[tuple[int, str]]:
        pages = self._reader(content).pages
        numbers = range(1, len(pages) + 1) if wanted is None else range(max(wanted.start, 1), min(wanted.stop, len(pages) + 1))
        return [(n, pages[n - 1].extract_text() or "") for n in numbers]

    def outline(self, content: bytes) -> list:
        reader = self._reader(content)

        def walk(items):
            for x in items:
                if isinstance(x, list):
                    yield list(walk(x))
                else:
                    try:
                        yield str(x.title), reader.get_destination_page_number(x) + 1
                    except Exception:
                        continue

        return list(walk(reader.outline))


#: Decoders by name, for options of a data source.
DECODERS: dict[str, type] = {"text": TextDecoder, "strict text": StrictTextDecoder, "pdf": PdfDecoder}


def flatten(outline: list, depth: int = 0) -> Iterator[tuple[int, str, int]]:
    """(depth, title, page) in reading order, with single spaces in titles."""
    for entry in outline:
        if isinstance(entry, list):
            yield from flatten(entry, depth + 1)
        else:
            yield depth, " ".join(entry[0].split()), int(entry[1])


def discover(spark: SparkSession, root: str, suffix: str = "pdf", recursive: bool = True, ignore_case: bool = True) -> DataFrame:
    """(path, key, filename, length, modified) of files by suffix. The key is the path below root; names repeat across folders. Contents are not read."""
    glob = "*." + ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix) if ignore_case else suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return keyed(files, root).select("path", "key", "filename", "length", F.col("modificationTime").alias("modified"))


def write_files(df: DataFrame, root: str, name: str, content: str) -> int:
    """Write each row's content as one file below root, through the file system that root names; the number of files. A task that runs again writes the same files again."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, data in zip(batch[name], batch[content]):
                target = f"{base}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(data if isinstance(data, bytes) else data.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return df.select(name, content).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def keyed(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    key = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), "^" + re.escape(base) + "/", "")
    return files.withColumn("key", key).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def read_files(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return keyed(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root), root)


def decode(files: DataFrame, decoder: Decoder) -> DataFrame:
    """files with pages (those without text left out, numbers kept), outline, sha256 and error. Each file is decoded once; a broken one has no pages and its error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    pages = [{"page_num": n, "text": t} for n, t in decoder.pages(bytes(content)) if t.strip()]
                    try:
                        outline = [{"depth": d, "title": t, "page": p} for d, t, p in flatten(decoder.outline(bytes(content)))]
                    except Exception:
                        outline = []
                    rows.append((pages, outline, None))
                except Exception as e:
                    rows.append(([], [], f"{type(e).__name__}: {e}"[:200]))
            out = pdf.drop(columns=["content"])
            out["pages"], out["outline"], out["error"] = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
            yield out

    hashed = files.withColumn("sha256", F.sha2("content", 256))
    columns = [f"`{n}` {t}" for n, t in hashed.dtypes if n != "content"]
    return hashed.mapInPandas(run, ", ".join([*columns, f"pages {PAGES_SCHEMA}", f"outline {OUTLINE_SCHEMA}", "error string"]))


def page_text(pages: Column, indices: tuple[int, ...]) -> Column:
    """Text of pages by index from 0, joined by newlines and stripped; pages that don't exist are skipped."""
    from ..operators.locate import fixed_pages

    return fixed_pages(pages, tuple(i + 1 for i in indices))


def page_range(pages: Column, first: int, last: int) -> Column:
    """Pages from first to last with a mark before each."""
    inside = F.filter(pages, lambda p: (p["page_num"] >= first) & (p["page_num"] <= last))
    return F.array_join(F.transform(inside, lambda p: F.concat(F.lit("--- PAGE "), p["page_num"].cast("string"), F.lit(" ---\n"), p["text"])), "\n")


def first_entries(outlines: DataFrame, key: str, targets: dict[str, str]) -> DataFrame:
    """For each document and target pattern the first outline entry that matches."""
    entries = outlines.select(key, F.posexplode("outline").alias("pos", "e"))
    hits = [entries.where(F.col("e.title").rlike(f"(?i){p}")).groupBy(key).agg(F.min_by("e", "pos").alias("e")).select(key, F.lit(name).alias("target"), "e.title", "e.page") for name, p in targets.items()]
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out
