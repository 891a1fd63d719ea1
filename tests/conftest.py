import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gazette.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", "8g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def evaluate(spark):
    """Values of a column function over a list of inputs."""

    def run(function, inputs, kind="string"):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
        out = rows.select("i", function(rows["x"]).alias("y")).orderBy("i").collect()
        return [r["y"] for r in out]

    return run


@pytest.fixture
def plan_of():
    """Executed plan text of a DataFrame."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()
