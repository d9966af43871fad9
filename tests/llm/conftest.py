import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and blank texts, a long one, ties, repeated rows, clashing names."""
    long = " ".join(f"wörd{'abcdefg'[i % 7]}{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n ", "en", "s", 4), (4, long, "en", "s", 5), (None, "a null id has text", "en", "s", 1),
        (5, "same text here", "en", "s", 1), (5, "same text here", "en", "s", 1), (6, "same text here, too", "en", None, 1), (None, None, "xx", "t", None), (7, "123 456", "de", "s", 1),
    ]
    clash = ("unit", "a", "b", "c", "best", "pairs", "docs", "holders", "term", "n", "total", "kept", "item", "value", "rank", "part", "digest", "place", "shard", "kind", "owner", "hot", "copies", "n_a", "groups_sha256", "x")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in clash})
