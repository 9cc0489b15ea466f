import pytest

#: Rows with nulls, empty and blank texts, repeats, ties, and columns whose names clash with the operators' own.
ODD = [
    (0, None, "en", "a"),
    (1, "", None, "b"),
    (2, "  \t\n ", "en", None),
    (3, "One two three four five six seven.", "en", "a"),
    (4, "One  two\tthree four five six seven.", "en", "b"),
    (4, "One  two\tthree four five six seven.", "en", "b"),
    (5, "  x \U0001f600 <|endoftext|> it's 12,5́", "fr", "c"),
    (None, "One two three four five six seven.", "en", "c"),
    (6, "word " * 30_000 + "end", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    for name in ("_id", "_norm", "keep_id", "rep", "start", "length", "_text", "key", "__spans", "__text", "score", "_gone", "gone", "c0", "digest", "_keep_id", "_keep_digest", "_own_digest", "_group", "_base", "sequence", "_lang", "_draw"):
        rows = rows.withColumn(name, F.lit(7))
    return rows.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
