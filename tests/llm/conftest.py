import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture()
def odd(spark):
    """Null, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(20_000))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, long, "en", "a"), (5, long, "en", "a"), (5, long, "en", "a"), (None, "some words that stand here alone and nowhere else at all", "de", "b"), (None, long + " tail", "de", "b"), (6, "same same same same", "en", "a"), (6, "other text of the same id", "en", "a"), (7, "é" * 120 + " ü", "fr", "c"), (8, "x" + "é" * 120, "fr", "c")]
    df = spark.createDataFrame([(*r, 0, 1, "k", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, batch int, key string, n double")
    return df


@pytest.fixture()
def none(odd):
    return odd.limit(0)
