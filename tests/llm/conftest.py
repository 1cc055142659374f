import pytest

from palimpsest.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("local[4]", 8)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"w{i % 5000}" for i in range(60_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(1, base, "en", "a", 5, 1.0, "x", "q"), (1, base, "en", "a", 5, 1.0, "x", "q"), (2, base, None, None, None, None, None, None),
            (3, None, "en", "a", 0, 2.0, None, "q"), (4, "", "en", "b", 0, 2.0, "y", None), (None, base, "en", "b", 1, 3.0, "z", "q"),
            (None, None, None, None, None, None, None, None), (5, long_text, "de", "b", 9, 0.0, "l", "q"), (6, " \t\n ", "de", "c", 3, 0.0, "l", "q"),
            (7, "one two", "de", "c", 3, 0.0, "l", "q"), (8, "One  TWO", "de", "c", 3, 0.0, "l", "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "_copies double, quality string, importance string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
