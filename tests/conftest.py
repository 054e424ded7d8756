import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text):
    import datetime as dt

    return dt.datetime.fromisoformat(text)


@pytest.fixture
def bars(spark):
    """bars(symbol, [(open, high, low, close), ...]) -> daily frame."""
    import datetime as dt

    def make(*series, volume=100.0):
        rows = [
            (symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(o), float(h), float(l), float(c), volume + i)
            for symbol, prices in series
            for i, (o, h, l, c) in enumerate(prices)
        ]
        return spark.createDataFrame(
            rows, "symbol string, datetime timestamp, open double, high double, low double, close double, volume double"
        )

    return make
