import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} {i}" for i in range(30_000))
    rows = [
        (0, "the quick brown fox jumps over the lazy dog " * 4, "en"),
        (1, None, "en"),
        (2, "", None),
        (3, "   \n\t ", "de"),
        (4, long_text, "en"),
        (4, long_text, "en"),
        (5, "the quick brown fox jumps over the lazy dog " * 4, None),
        (6, "\x00 zero byte \x00 and é𝄞 marks", "fr"),
        (None, "no id at all but some words here", "fr"),
        (7, "x", "es"),
        (7, "same id another text", "es"),
    ]
    shaped = [(*r, "src", 1, "key", 5, 0.5, "n", "w") for r in rows]
    return spark.createDataFrame(
        shaped, "doc_id long, text string, lang string, source string, n_chars long, key string, node int, score double, label string, kept string"
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
