import pytest

LONG = "long " * 30000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns of other names."""
    rows = [(1, "alpha beta gamma delta epsilon zeta", 5, "x"), (1, "alpha beta gamma delta epsilon zeta", 5, "x"), (2, "", 0, None), (3, None, None, None), (None, "alpha beta gamma delta epsilon zeta", 1, "y"), (4, LONG, 9, "z"), (5, " \n\t ", 3, "z"), (6, "\U0001f600 é", 2, "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, part string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
