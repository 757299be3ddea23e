import pytest

from listingscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


@pytest.fixture
def table(spark):
    """Small DataFrame from a DDL schema and rows."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
