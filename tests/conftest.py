import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segtide.session import new_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = new_session("tests", "local[8]", **{
        "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SF_DIR


@pytest.fixture
def rows(spark):
    """DataFrame from tuples and a schema text."""
    return lambda data, schema: spark.createDataFrame(data, schema)


def at(text: str):
    from datetime import datetime
    return datetime.fromisoformat(text)
