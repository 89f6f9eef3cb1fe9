import pytest

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
        (2, "the quick brown fox jumps over the lazy dog again", None, "b", 49),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n ", "en", "b", 4),
        (6, LONG, "en", "a", len(LONG)), (7, "éß €𝄞 word", "de", None, 10), (None, "no id here", None, None, None),
        (None, "no id here", None, None, None), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 0, 1), (7, 1, None), (8, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd documents with columns that bear the operators' own names."""
    from pyspark.sql import functions as F

    names = ["_h", "n_bytes", "_slot", "shard", "shard_depth", "_over", "score", "block", "epoch", "position", "fp", "component_id", "least_id", "_leak_id", "secrets", "_text", "kept", "base_failed", "n_words", "_found", "pii_spans", "h", "t", "_s", "_n", "_b", "key", "count"]
    return odd.withColumns({n: F.lit("x") for n in names})
