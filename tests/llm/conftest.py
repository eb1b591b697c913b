import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and wordless texts, a repeated row, ties, and columns with clashing names."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [
        (5, "One two three four five six seven.", "en", "a", 1), (3, "One  two three\tfour five six seven.", None, None, None),
        (3, "One  two three\tfour five six seven.", None, None, None), (None, "One two three four five six seven.", "en", "a", 1),
        (7, None, "en", "a", 1), (8, "", None, "a", 1), (9, " \n\t ", "en", None, 1), (10, "word", "en", "a", None), (11, long, "en", "a", 1),
        (12, long + " more", "en", "a", 1), (13, "日本語 texte é", "xx", "b", 3),
    ]
    rows = [(*r, 1, "x", "y", 2.0, "z") for r in rows]
    return spark.createDataFrame(rows, SCHEMA + ", digest int, file string, node string, score double, word string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
