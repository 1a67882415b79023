import pytest

SCHEMA = "doc_id long, text string, digest string, row int, n int, t string"


@pytest.fixture
def docs(spark):
    """Documents with further columns whose names could clash with inner ones."""
    return lambda rows: spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in rows], SCHEMA)


@pytest.fixture
def table(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
