import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long, equal and repeated texts, null ids, and columns whose names operators use themselves."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    same = " ".join(f"s{i}" for i in range(80))
    rows = [
        (1, same, "en", "a"), (2, same, "en", None), (2, same, "en", None), (3, None, None, "a"), (4, "", "", ""), (5, long, "de", "b"),
        (6, long[:5000] + " end", "de", "b"), (None, "no id here", "en", "a"), (7, "   \n\t ", "en", "b"), (8, "é ü 日本語 😀", "fr", "a"),
    ]
    extra = [(*r, "x", 1, 2.0, True, "y") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, doc string, size int, posterior double, kept boolean, class_id string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
