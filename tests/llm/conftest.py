import pytest


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and extra columns with names the operators use."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    passage = " ".join(f"shared{i} passage word" for i in range(40))
    rows = [
        (1, "plain words here and there", "s", 1),
        (2, None, None, None),
        (3, "", "s", 2),
        (4, long, "t", 3),
        (5, "plain words here and there", "s", 1),
        (5, "plain words here and there", "s", 1),
        (None, passage + " tail", "s", 4),
        (7, "start one " + passage, "t", 4),
        (8, "another start " + passage + " end é ß 日本", "t", 4),
        (9, " \t\n ", "s", 0),
        (10, "a" * 5000, "s", 0),
        (11, "\x00 nul \x1c sep " + "a" * 300, "s", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return df.selectExpr("*", "text AS id", "n_chars AS h", "source AS fp", "1 AS _block", "2 AS tx", "3 AS length", "text AS kept", "0 AS score", "1 AS y", "2 AS row")


@pytest.fixture(scope="session")
def none_at_all(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
