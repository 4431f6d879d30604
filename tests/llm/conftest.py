import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, key string, n int, part long, row long, id long"


def frame(spark, rows):
    """documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", "k", 1, 2, 3, 4) for i, t in rows], DDL)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null and empty texts, repeated rows, odd white space, a long text, all scripts."""
    rows = [(1, None), (2, ""), (3, "One two three four five six."), (3, "One two three four five six."), (None, "One two three four five six."), (5, "x" * 5000),
            (6, "  tab\t\tand\n\n lines   nbsp "), (7, "日本語 текст émoji 🙂🙂 ① ²"), (8, "a b"), (9, "word " * 4000), (None, None), (10, "<|endoftext|> it's")]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
