import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, _key int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    base = "the cat sat on the mat and looked at the moon for a very long time until it was morning again"
    rows = [
        (1, base, "en", "a", 10, "x", 1),
        (1, base, "en", "a", 10, "x", 1),
        (2, base, "en", None, 10, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, "", 0),
        (5, "   \n\t ", "en", "b", 5, "", 0),
        (None, base + " again", None, "b", None, "y", 2),
        (None, None, None, None, None, None, None),
        (6, LONG, "en", "c", len(LONG), "z", 3),
        (7, "naïve 你好 🎉 ﬁ mail me at Jo.Doe+x@Mail.example.com or +1 (555) 010-9999 now", "en", "c", 60, "z", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
