import pytest

import corpus_pipeline
from dossier.llm import decontaminate, licences, media, secrets, wordpiece


@pytest.fixture(scope="module")
def benchmark_table(spark, small):
    return spark.read.parquet(f"{small}/benchmark.parquet")


def test_operators_on_an_empty_table(spark, awkward, benchmark_table):
    none = awkward.limit(0)
    for out in (media.media_columns(spark, none), secrets.secret_spans(none), licences.licence_report(none), decontaminate.contaminated(none, benchmark_table), wordpiece.token_counts(none)):
        assert out.count() == 0 and "doc_id" in out.columns


def test_no_benchmark(spark, awkward, benchmark_table):
    assert decontaminate.without_contaminated(awkward, benchmark_table.limit(0)).count() == awkward.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_and_awkward_tables(spark, small, awkward, name, stage):
    docs = awkward.select(*corpus_pipeline.COLUMNS)
    for df in (docs.limit(0), docs):
        out = stage(spark, df, small)
        rows = out.collect()
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and len(rows) <= df.count()
        if name != "mixing":
            assert out.columns == corpus_pipeline.COLUMNS
