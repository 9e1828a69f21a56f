import corpus_pipeline as P
import pytest
from oracle import same

from dossier.llm import line_dedup, mixing


@pytest.fixture(scope="module")
def stages(spark, small):
    """Outputs of all stages, the input first."""
    out = [("documents", spark.read.parquet(f"{small}/documents.parquet").cache())]
    for name, stage in P.STAGES:
        out.append((name, stage(spark, out[-1][1], small).cache()))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_effects(stages):
    for (_, before), (name, after) in zip(stages, stages[1:]):
        assert ids(after) <= ids(before)
        assert after.columns[: len(P.COLUMNS)] == P.COLUMNS
        assert name == "mixing" or after.columns == P.COLUMNS


def test_line_and_mixing_stages_equal_their_sql(stages, tmp_path):
    for n, sql in ((2, line_dedup.SQL), (5, mixing.SQL)):
        folder = tmp_path / str(n)
        folder.mkdir()
        stages[n - 1][1].toPandas().to_parquet(folder / "documents.parquet")
        if n == 2:
            import duckdb

            want = duckdb.sql(sql.replace("FROM documents", f"FROM '{folder}/documents.parquet'")).fetchall()
            import hashlib

            got = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in stages[n][1].collect()}
            assert got == {r[0]: r[3] for r in want}
        else:
            same(stages[n][1].select("doc_id", "lang", "source", "n_tokens", "copies"), sql, str(folder))


def test_near_stage_keeps_one_of_each_group(stages):
    from test_llm_operators import near_groups

    want = {i for i, v in near_groups([(r.doc_id, r.text) for r in stages[2][1].collect()], percent=80).items() if v[2]}
    assert ids(stages[3][1]) == want


def test_near_stage_links_from_four_fifths(spark):
    """Pairs of texts with overlaps of exactly 0.84, 0.80 and 0.79: the first 88, 84 and 83 of 104 words."""
    rows = []
    for n, words in enumerate((88, 84, 83)):
        base = [f"{'abc'[n]}{i}" for i in range(104)]
        rows += [(2 * n, " ".join(base), "en", "src", 1), (2 * n + 1, " ".join(base[:words]), "en", "src", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(P.near_stage(spark, docs, "")) == {0, 2, 4, 5}


def test_benchmark_stage_drops_what_holds_an_item(spark, stages, small):
    from dossier.llm.decontaminate import normal

    items = [normal(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for r in stages[4][1].collect():
        assert not any(i in normal(r.text) for i in items)
    lost = ids(stages[3][1]) - ids(stages[4][1])
    assert len(lost) <= 0.2 * stages[3][1].count()


def test_run_equals_the_stages(spark, small, stages):
    assert ids(P.run(spark, small)) == ids(stages[-1][1])
