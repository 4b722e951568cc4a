import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foundling.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one text column ``t`` (or given columns)."""

    def run(expr, **columns):
        from pyspark.sql import functions as F

        columns = columns or {"t": None}
        df = spark.range(1).select(*[
            (F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in columns.items()
        ])
        return df.select(expr.alias("x")).collect()[0]["x"]

    return run
