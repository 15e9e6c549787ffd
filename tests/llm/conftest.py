import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of documents (doc_id, text and any more columns) over several partitions."""

    def make(rows, ddl="doc_id long, text string"):
        return spark.createDataFrame(rows, ddl).repartition(3)

    return make
