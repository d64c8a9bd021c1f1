import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

from corpusloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, partitions=4, app="corpusloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate expressions over one row of named values: one(expr, x=...) gives the value."""
    from pyspark.sql import functions as F

    def run(expr, **values):
        frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return frame.select(expr.alias("out")).first()["out"]

    return run
