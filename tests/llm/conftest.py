import pytest
from llm_cases import SCHEMA


@pytest.fixture
def table(spark):
    """Makes a documents table from (doc_id, text) pairs or longer rows, in a few partitions."""

    def make(rows, extra=""):
        full = [tuple(r) + (None, None, None)[len(r) - 2 :] if len(r) < 5 else tuple(r) for r in rows]
        return spark.createDataFrame(full, SCHEMA + extra).repartition(3)

    return make
