import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tradeloom.materialize import scratch_if_unset  # noqa: E402
from tradeloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    scratch_if_unset(session)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate an expression of one typed input per row: ``one("string", values, expr)``."""

    def evaluate(kind, values, expression):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in df.select(expression(df["v"]).alias("out"), "i").orderBy("i").collect()]

    return evaluate
