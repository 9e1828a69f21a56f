import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long, `__row` string, key int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty texts, a very long one, copies, a repeated row, a repeated id, and columns that clash with internal names."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = "\n".join(f"{word} number {i} and more words to fill the line" for i in range(3000))
    rows = [
        (1, None, "en", "src1", None, None, 1), (2, "", None, None, 0, "x", 2), (3, word, "en", "src1", 9, "x", 3), (4, word.upper(), "en", "src2", 9, None, None),
        (5, long, "fr", "src2", 9, "x", 5), (6, long, "fr", "src3", 9, "x", 5), (None, word, "de", "src3", 9, "x", 7), (8, "one two\n\n  One two three four \nend", "es", "src4", 9, "x", 8),
        (8, "one two\n\n  One two three four \nend", "es", "src4", 9, "x", 8), (9, "prefix one\nONE TWO THREE FOUR\nend", "es", "src4", 9, "x", 8), (9, "another text", "es", "src4", 9, "x", 8), (10, "é" * 300, "fr", "src5", 9, "x", 9),
    ]
    return spark.createDataFrame(rows, TEXT).repartition(3).cache()
