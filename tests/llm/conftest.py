import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A table from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
