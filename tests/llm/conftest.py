import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside or give back
CLASHES = ["size", "target", "row", "score", "a", "b", "label", "n", "kept", "component_id", "bucket", "epochs", "ids", "text2"]
PROSE = ("The quick brown fox jumps over the lazy dog while a small bird sings in the old tree near the river. " * 3).strip()


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and extra columns with clashing names."""
    long_text = "\n".join(f"word{i} and line {i % 977} of a long text" for i in range(20_000))
    rows = [
        (1, PROSE, "en", "s1", 1), (2, PROSE, "en", "s1", 1), (2, PROSE, "en", "s1", 1), (3, None, "en", "s2", None),
        (4, "", "de", None, 0), (5, " \t\n ", None, None, 3), (None, PROSE, "en", "s1", 1), (None, None, None, None, None),
        (6, "eins zwei drei vier", "de", "s2", 5), (7, "12 34 !!! ###", "de", "s2", 5), (8, long_text, "en", "s3", 9),
        (9, "eins zwei drei vier", "de", "é", 5), (10, "x", "fr", "", 1), (11, "   café \U0001f600\x1c z", "fr", "s2", 7),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, None), (3, 0, 0), (6, 1, 0), (7, 0, 0), (None, 1, 1), (8, None, 0), (99, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
