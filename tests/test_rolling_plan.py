from pyspark.sql import functions as F

from barweave.operators import base_features as bf


def test_only_needed_sums_are_carried_and_each_is_worked_out_once(spark, bars):
    frame = bf.add_rolling(bf.add_shape(bf.add_returns(bars(("A", [(10, 11, 9, 10 + i % 3) for i in range(40)])))), (20,))
    plan = frame.select("symbol", "datetime", "volatility_20")._jdf.queryExecution().optimizedPlan().toString()
    assert "_q_ret" in plan and "_s_value" not in plan and "_q_close" not in plan  # sums of other series are pruned
    whole = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(" not in whole and "_sum_20_close" in whole
    assert frame.where(F.col("volatility_20").isNotNull()).count() == 30
