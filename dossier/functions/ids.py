"""Keys derived from paths, file names and product names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as C
from .text import collapse, strip


def provenance(key: Column) -> tuple[Column, Column]:
    """The folder and the folder above it; empty where the path is too short."""
    parts = F.split(key, "/")
    up = lambda n: F.when(F.size(parts) >= n, F.element_at(parts, -n)).otherwise(F.lit(""))
    return up(2), up(3)


def record_id(filename: Column) -> Column:
    return F.replace(filename, F.lit(".pdf"), F.lit(""))


def match_id(c: Column) -> Column:
    return collapse(strip(F.lower(F.regexp_replace(strip(c), r"(?i)\.pdf$", ""))))


def product_key(filename: Column) -> Column:
    """Name without extension, from the first number on cut off, letters and digits only."""
    stem = F.lower(F.regexp_replace(filename, r"(?i)\.pdf$", ""))
    return F.regexp_replace(F.regexp_replace(stem, r"[\s\-_]+\d.*$", ""), "[^a-z0-9]", "")


def release_id(c: Column) -> Column:
    """The name in lower case without its extension, in whatever case that is; `X.pdf-2.pdf`, a second copy, is `x-2`."""
    copies = F.regexp_replace(c, r"(?i)\.pdf([-_]\d+)\.pdf$", "$1")
    return F.lower(strip(F.regexp_replace(copies, r"(?i)\.pdf$", "")))


def word_bag(c: Column) -> Column:
    """Words of four letters or more but `and`, sorted: a key that ignores order and separators."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0), lambda w: w != "and")
    return F.array_join(F.array_sort(words), " ")


def aliased(name: Column) -> Column:
    out = F.lower(strip(name))
    for a, b in C.NAME_ALIASES.items():
        out = F.when(F.lower(strip(name)) == a, F.lit(b)).otherwise(out)
    return out
