import pytest
from llm_helpers import as_frame, edge_texts


@pytest.fixture(scope="session")
def edge_docs(spark):
    return as_frame(spark, edge_texts())


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_frame(spark, [])


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows: as_frame(spark, rows)
