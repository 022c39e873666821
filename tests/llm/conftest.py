import pytest

NASTY = [
    (0, "", "en", "src0"), (1, None, "de", "src1"), (2, "   \t\n ", None, None), (3, "one", "en", "src0"), (4, "one", "en", "src0"), (4, "one", "en", "src0"),
    (None, "a row without id that has some words in it", "fr", "weird"), (5, "A b C d E f G h", "en", "src2"), (6, "a B c D e F g H", "en", "src3"),
    (7, "don't <|endoftext|> it's \u00e9\u00e8 \U0001f600 12345  \n\n x", "es", "src10"), (8, "x" * 30_000, "en", "src0"), (9, "word " * 8_000, "en", "src0"),
]


@pytest.fixture()
def nasty(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and a column with a clashing name."""
    return spark.createDataFrame([(*r, 1.5) for r in NASTY], "doc_id long, text string, lang string, source string, size double")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, size double")
