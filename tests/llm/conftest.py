import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 50_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    prose = "The quick brown fox jumps over the lazy dog while seven wizards box quietly near the old stone bridge tonight"
    rows = [
        (1, prose, "en", "a", 5), (1, prose, "en", "a", 5), (2, prose, "en", "a", 5), (3, None, "en", "b", None), (4, "", None, None, 0),
        (None, prose + " again", "en", "a", 1), (5, LONG, "en", "a", 1), (6, " \n\t ", "de", "b", 3), (7, "zwei", None, "b", 4), (8, "***", "de", None, 3),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "component_id", "words", "key", "shard", "slot", "bucket", "epochs", "digest", "size", "n_words", "failed", "at", "node", "root", "u", "v", "row", "place"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
