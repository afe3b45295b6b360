import sys
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def limits(spark):
    """Lower size limits, so that small data takes the plans meant for large data."""

    @contextmanager
    def lowered(**values):
        for name, value in values.items():
            spark.conf.set(f"spark.depweave.{name}", str(value))
        try:
            yield
        finally:
            for name in values:
                spark.conf.unset(f"spark.depweave.{name}")

    return lowered
