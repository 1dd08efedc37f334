import pytest
from pyspark.sql import functions as F

#: Columns that operators might use inside.
CLASHING = ["node", "key", "h", "n", "size", "block", "label", "runs", "keep_id", "text_sha256", "score", "held_out", "component", "word", "_lang_id", "_kept_sha", "_kept_id", "_bad_id", "_bad_key", "_class_id", "_id", "_none", "_key", "row", "text_key", "routes"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing columns."""
    passage = "the quick brown fox jumps over the lazy dog while seven wizards boil strange purple potions under an old stone bridge near the river "
    rows = [
        (1, passage * 3, "en", "s"),
        (2, passage * 3, "en", "s"),
        (2, passage * 3, "en", "s"),
        (3, None, None, None),
        (4, "", "en", None),
        (5, " \n\t ", "fr", "s"),
        (6, passage * 3 + "with one more ending here", "de", "s"),
        (7, "mot " * 40_000, "fr", "s"),
        (8, "é" * 300 + " ñandú 日本語 😀 " + passage, None, "s"),
        (None, passage + "tail without an id", "en", "s"),
        (None, None, "en", "s"),
        (9, "unrelated words stand here alone and share nothing with others", "en", "s"),
        (9, "the same id but another text altogether, of some length, for the tests of identity", "en", "s"),
        (10, "one", "en", "s"),
        (11, "ONE!", "en", "s"),
        (12, "a\x00b ▁ \u2028 end", "es", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")


@pytest.fixture(scope="session")
def plain(odd_docs):
    """The rows of odd_docs in Python: (doc_id, text)."""
    return [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
