"""Memoised lookups of outside services: distinct keys, fetched once, kept in a table."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fetch_json(url: str, timeout: float = 30) -> str:
    import urllib.request

    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode()


def fetch_bytes(url: str, timeout: float = 60) -> bytes:
    import urllib.request

    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


def fetch_document(first_text: Callable[[bytes], str], timeout: float = 60) -> Callable[[str], str]:
    """A fetcher for `lookup`: a document's SHA-256 and the text of its first page, as JSON. first_text decodes the bytes."""

    def fetch(url: str) -> str:
        data = fetch_bytes(url, timeout)
        return json.dumps({"sha256": hashlib.sha256(data).hexdigest(), "text": first_text(data)})

    return fetch


def fetched_document(value: Column) -> Column:
    """What fetch_document keeps, as a struct; null where fetching failed."""
    return F.from_json(value, "sha256 string, text string")


def lookup(keys: DataFrame, key: str, known: DataFrame | None, fetch: Callable[[str], str], attempts: int = 3, backoff: float = 2.0, pace: float = 0.2) -> DataFrame:
    """(key, value, error) for the distinct keys that `known` lacks, with the known ones. Errors are values too and are not fetched again. Save the result: it is the memo."""
    todo = keys.select(key).where(F.col(key).isNotNull()).distinct()
    if known is not None:
        todo = todo.join(known, key, "left_anti")

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf[key]:
                error = None
                for attempt in range(attempts):
                    try:
                        rows.append((k, fetch(k), None))
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(backoff if attempt + 1 < attempts else 0)
                else:
                    rows.append((k, None, error))
                time.sleep(pace)
            yield pd.DataFrame(rows, columns=[key, "value", "error"])

    fresh = todo.mapInPandas(run, f"`{key}` string, value string, error string")
    return fresh if known is None else known.select(key, "value", "error").unionByName(fresh)


def similarity(a: Column, b: Column, words: int = 600) -> Column:
    """Ratcliff-Obershelp ratio of the first words of two texts, which Spark has no function for."""

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        import difflib

        cut = lambda t: (t or "").split()[:words]
        return pd.Series([difflib.SequenceMatcher(None, cut(x), cut(y), autojunk=False).ratio() for x, y in zip(xs, ys)])

    return run(a, b)
