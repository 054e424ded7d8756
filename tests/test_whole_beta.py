import datetime as dt

from pyspark.sql import functions as F

from barweave.operators import valuation as va
from barweave.plans import strategy


def test_beta_of_the_whole_history_counts_its_oldest_months(spark):
    """Ten years of months: the stock moved against the benchmark in the first five, with it in the last five."""
    rows, stock, bench = [], 100.0, 100.0
    for i in range(120):
        move = 0.01 * (1 + i % 5)
        bench *= 1 + move
        stock *= 1 + (-move if i < 60 else move)
        rows.append((dt.datetime(2010 + i // 12, i % 12 + 1, 15), stock, bench))
    frame = spark.createDataFrame(rows, "datetime timestamp, s double, b double")
    bars = frame.select(F.lit("A").alias("symbol"), "datetime", F.col("s").alias("close"))
    benchmark = frame.select(F.lit("B").alias("symbol"), "datetime", F.col("b").alias("close"))
    assert va.monthly_beta(bars, benchmark).first().beta > 0.7
    assert abs(va.monthly_beta(bars, benchmark, days=None).first().beta) < 0.3


def test_query_and_sql_read_every_bar():
    assert "INTERVAL 1899 DAY" not in strategy.WHOLE_BETA_SQL and "INTERVAL 1899 DAY" in strategy.BETA_SQL
