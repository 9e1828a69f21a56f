"""Corpus pipeline over the documents table: rate, drop repeated lines, keep one of near copies, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Part of the
training-data subpackage, from which all operators come. An empty table goes through all stages as one. Nulls, ties, repeated rows and
texts of any length have the results that the operators state: null and empty texts are rated, hold one empty line, are near nothing, contain no
benchmark item and have no tokens; rows that share an id are one document where lines and near copies are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontaminate, line_dedup, minhash, mixing, quality
from dossier.llm.workspace import Workspace, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.rate_documents(docs, table(spark, sf_dir, "labels")).where("__keep").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; n_chars follows the text, and documents left empty stay."""
    kept = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies; documents without words stay.

    Near is an overlap of 0.80 or more, lower than in op10. With 14 tables a pair at exactly 0.80 shares no key with probability 8.7e-5.
    """
    dropped = minhash.near_duplicates(docs.select("doc_id", "text"), percent=80, tables=14).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights choose, with their tokens and copies."""
    chosen = mixing.mix(docs.select(*COLUMNS), mixing.document_levels(), [mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}])
    return chosen.withColumnsRenamed({"__n_tokens": "n_tokens", "__copies": "copies"})


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the edit matching have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's output is written in the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
