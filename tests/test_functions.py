import pytest
from pyspark.sql import functions as F

from dossier.functions import catalog as C
from dossier.functions import ids, text
from dossier.functions import keyword_list as K


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first()["o"]


LISTS = [
    (None, None, "empty response"),
    ("  ", None, "empty response"),
    ("********", "********", "ok"),
    ('"******"', "******", "ok"),
    ("asthma, and fever,  cough.", "asthma, fever, cough", "ok"),
    ("- asthma\n- fever", "asthma, fever", "ok"),
    ("1. asthma; 2) fever", "asthma, fever", "ok"),
    ("```\nasthma, fever\n```", "asthma, fever", "ok"),
    ("Adverse events: Nausea, nausea, NAUSEA", "Nausea", "ok"),
    ("take b.i.d., daily.", "take b.i.d., daily", "ok"),
    ("Here is a summary: asthma", None, "contains conversational phrase 'here is a summary'"),
    ("Here's the list, asthma", None, "contains conversational phrase \"here's the\""),
    ("asthma\n\nfever", None, "contains multiple paragraphs"),
    ("It helps. It works", None, "contains sentence breaks"),
    ("one two three four five six seven eight nine ten eleven twelve thirteen", None, "single long phrase with no commas"),
    ("- " + "word " * 13 + "\n- " + "term " * 13, None, "bulleted list of long clauses"),
    (", ;", None, "no list items found"),
    ("a, " + "w " * 21 + ", " + "x " * 22, None, "2 of 3 items were over-long"),
]


@pytest.mark.parametrize("raw,value,reason", LISTS)
def test_list_contract(spark, raw, value, reason):
    row = K.normalize(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert (row["value"], row["reason"]) == (value, reason)


def test_list_contract_is_idempotent(spark):
    df = spark.createDataFrame([(r,) for r, v, _ in LISTS if v], "raw string")
    once = K.normalize(df, "raw").select("value")
    for row in K.normalize(once, "value", value="again").collect():
        assert row["reason"] == "ok"


@pytest.mark.parametrize("answer,source,ok", [("hypertension", "for hypertensive patients", True), ("asthma, fever, cough", "only asthma here", False), ("asthma, fever", "asthma", True), ("asthma", "", True)])
def test_grounding(spark, answer, source, ok):
    row = K.normalize(spark.createDataFrame([(answer, source)], "a string, s string"), "a", "s").first()
    assert (row["reason"] == "ok") is ok
    if not ok:
        assert row["reason"].startswith("only 33% of 3 terms")


def test_normalize_keeps_other_columns(spark):
    df = spark.createDataFrame([("a", 1, "x")], "raw string, value int, extra string")
    assert K.normalize(df, "raw").columns == ["raw", "extra", "value", "reason"]


def test_answer_items(spark):
    df = spark.createDataFrame([("Here are the items: HereditaryAngioedema; concomitant_use\n- and Aspirin, none, drugx", "DrugX")], "a string, d string")
    assert df.select(K.answer_items(F.col("a"), F.col("d")).alias("o")).first()["o"] == ["Hereditary Angioedema", "concomitant use", "Aspirin"]


def test_empty_values(spark):
    df = spark.createDataFrame([(v,) for v in (None, " ", "ERROR: x", "No information", "******", "fever")], "v string")
    assert [r[0] for r in df.select(text.is_empty(F.col("v"))).collect()] == [True] * 5 + [False]


def test_none_found_counts_as_empty_unless_asked(spark):
    assert one(spark, "NONE_FOUND", K.item_set) == []
    assert one(spark, "NONE_FOUND", lambda c: K.item_set(c, False)) == ["none_found"]


@pytest.mark.parametrize("v,out", [("CYP3A4/5 and cyp 2d6", "CYP2D6, CYP3A4, CYP5"), ("", "no"), (None, "no"), ("cytochrome P450 2C9", "CYP2C9")])
def test_enzymes(spark, v, out):
    got = one(spark, v, text.enzymes)
    assert set(out.split(", ")) <= set(got.split(", "))


def test_options(spark):
    assert one(spark, "I would say contraindicated in patients with LIVER impairment", lambda c: text.dose_option(c, C.LIVER_OPTIONS)) == C.LIVER_OPTIONS[3]
    assert one(spark, "something else", lambda c: text.dose_option(c, C.LIVER_OPTIONS)) == "something else"
    assert one(spark, None, lambda c: text.dose_option(c, C.LIVER_OPTIONS)) == "EXTRACTION_FAILED"
    assert one(spark, "Contraindicated", lambda c: text.status_option(c, C.PREGNANCY_OPTIONS)) == "NO INFORMATION"
    assert one(spark, "Contraindicated", lambda c: text.status_option(c, C.PREGNANCY_OPTIONS, True)) == "CONTRANDICATED"
    assert one(spark, "use with caution; not recommended", lambda c: text.option_earliest(c, C.PREGNANCY_OPTIONS, "NO INFORMATION")) == "USE WITH CAUTION"


def test_option_that_begins_another(spark):
    """A text that is one option whole names the shorter one at the same place, as in a longer text."""
    for said in ("der", '"Der."', "Der Tag", " DER\n"):
        assert one(spark, said, lambda c: text.option_earliest(c, ("DER", "DE", "LA"), "none")) == "DE"


def test_metadata(spark):
    assert list(one(spark, "Brand\n Firm ", text.metadata)) == ["Brand", "Firm"] + ["N/A"] * 4
    assert list(one(spark, None, text.metadata)) == ["NO_TEXT_FOUND"] * 6


def test_keys(spark):
    assert one(spark, "APO-ENALAPRIL 5mg.pdf", ids.product_key) == "apoenalapril"
    assert one(spark, "AMLODIPINE 10mg.pdf-2.pdf", ids.release_id) == "amlodipine 10mg-2"
    bags = {one(spark, v, ids.word_bag) for v in ("Sulfamethoxazole and Trimethoprim", "Trimethoprim-Sulfamethoxazole")}
    assert bags == {"sulfamethoxazole trimethoprim"}
    df = spark.createDataFrame([("a/b/c.pdf",), ("c.pdf",)], "k string")
    folder, above = ids.provenance(F.col("k"))
    assert [tuple(r) for r in df.select(folder, above).collect()] == [("b", "a"), ("", "")]
    assert one(spark, "Cephalexin", ids.aliased) == "cefalexin"


def test_flexible_title(spark):
    assert one(spark, "DOSAGE AND ADMINISTR ATION", lambda c: c.rlike(text.flexible("DOSAGE AND ADMINISTRATION")))


def test_cleanups(spark):
    assert one(spark, "- a\nb  c", text.paragraph) == "a b c"
    assert one(spark, "", text.paragraph) == "SUMMARY_GENERATION_FAILED"
    assert one(spark, "a ,b and c,", text.interactions_list) == "a, b, c"
    assert one(spark, "********", text.warnings_list) == "******"
    assert one(spark, "Urine elimination: 5%", text.elimination).endswith("Faeces elimination: ERROR")
    assert one(spark, "10mg 2.50 2.50", text.strengths) == ["10", "2.5"]
    assert one(spark, "Pharma Inc Bay 1", text.name_words) == ["bay"]


def test_scrub_and_release_clean(spark):
    df = spark.createDataFrame([("a\x01b contrandicated x", 1)], "s string, n int")
    assert text.scrub_controls(df).first()["s"] == "ab contrandicated x"
    assert text.release_clean(df).first()["s"].endswith("contraindicated x")


def test_items_are_trimmed_in_every_evaluation(spark):
    """The same expression over many rows, partitions and runs: no evaluation may leave blanks that another removes."""
    df = spark.range(4000).select(F.lit("dizziness , nausea ;  Dizziness").alias("raw"))
    for parts in (1, 4, 9):
        assert [tuple(r) for r in K.normalize(df.repartition(parts), "raw").select("value", "reason").distinct().collect()] == [("dizziness, nausea", "ok")]


def test_distinct_items_keep_the_first_in_order(spark):
    df = spark.createDataFrame([(["b", "A", "B", "a", "é", "É", ""],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(K.distinct_items(F.col("x"))).collect()] == [["b", "A", "é", ""], []]
