from barweave.operators import walkforward as wf
from barweave.plans import learning


def test_only_needed_columns_are_dealt_to_windows(monkeypatch):
    seen = []
    monkeypatch.setattr(learning, "weekly_bars", lambda spark, folder: spark)
    monkeypatch.setattr(wf, "walk_forward", lambda frame, *a, **k: seen.append(frame.columns))
    monkeypatch.setattr(learning.lb, "walk_forward_windows", lambda *a: None)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[1]").getOrCreate()
    learning.walked(spark.createDataFrame([], "symbol string, datetime timestamp, open double, high double, low double, close double, volume double"), "")
    assert {"ret_1", "volatility_20", "pattern"} <= set(seen[0]) and not {"z_close_20", "open", "gap"} & set(seen[0])
