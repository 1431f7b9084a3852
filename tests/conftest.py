import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodeseek.runtime import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one expression over a column of values."""
    def run(column, rows, schema="x string"):
        df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
        return [row[0] for row in df.select(column).collect()]

    return run
