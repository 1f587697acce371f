import duckdb
import pytest
from pyspark.sql import functions as F

ODD = "doc_id long, text string, lang string, source string, n_chars long, key long, line string, score double, word string, `case when` string"


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def small_labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, one id with two texts, and columns whose names the operators use inside."""
    long = " ".join(f"word{i % 997}" for i in range(30000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n \t\n", "en", "s", 6), (4, "one", "en", "s", 3), (5, long, "en", "s", len(long)),
            (6, "a b c d e f g h\nsame line of words here\nsame line of words here", "en", None, 10), (6, "a b c d e f g h\nsame line of words here\nsame line of words here", "en", None, 10),
            (7, "a b c d e f g h\nanother line altogether", "de", "s", None), (7, "quite another text of the same id", "de", "s", 1), (None, "a text without an id", None, "s", 3),
            (None, None, None, None, None), (8, "!!! ### %%%", "", "", 1), (9, "éàü " * 40, "fr", "s", 160)]
    return spark.createDataFrame([(*row, 1, "x", 0.5, "w", None) for row in rows], ODD)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where(F.lit(False))


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 1), (6, 1, 1), (7, 0, None), (None, 1, 1), (8, None, 1), (99, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
