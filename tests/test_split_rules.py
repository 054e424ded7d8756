"""Edge cases of splits and windows, exact AUC, and the cost of long histories."""

import datetime as dt
import time

import numpy as np
from pyspark.sql import functions as F

from barweave.functions.prefix import Rolling, Series
from barweave.functions.windows import by_symbol
from barweave.operators import labels as lb, learn as ml, thresholds as th
from barweave.operators.signals import Costs


def daily(spark, n, symbol="A"):
    rows = [(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, datetime timestamp, close double")


def test_one_date_splits_by_symbol(spark):
    one = spark.createDataFrame([(f"s{i}", dt.datetime(2024, 1, 1)) for i in range(11)], "symbol string, datetime timestamp")
    assert lb.chronological_split(one).where("split = 'test'").count() == 3
    assert lb.chronological_split(one.limit(0)).count() == 0


def test_no_window_starts_on_the_last_date(spark):
    starts = [r.test_start.day for r in lb.walk_forward_windows(daily(spark, 31), 10, 5, 5).orderBy("test_start").collect()]
    assert starts == [11, 16, 21, 26]


def test_test_labels_end_inside_the_window(spark):
    bars = lb.add_label_end(daily(spark, 31), 2)
    rows = lb.assign_windows(bars, lb.walk_forward_windows(bars, 10, 5, 5), "1d", 1)
    own = [(r.datetime.day, r.role) for r in rows.where("window_no = 0").orderBy("datetime").collect()]
    assert own == [(d, "train") for d in range(1, 10)] + [(12, "test"), (13, "test")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_auc_of_close_scores_is_exact(spark):
    rng = np.random.default_rng(1)
    score = 0.5 + np.round(rng.normal(size=400), 1) * 1e-9
    label = (rng.random(400) < 0.5).astype(int)
    table = spark.createDataFrame(list(zip(["k"] * 400, label.tolist(), score.tolist())), "k string, y int, p double")
    pairs = [(a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0]]
    for keys in (["k"], []):
        assert abs(ml.binary_metrics(table, keys, "y", "p").first().roc_auc - np.mean(pairs)) < 1e-12


def test_validation_trades_pay_no_borrow(spark):
    rows = [("m", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 0.8 if i % 2 else 0.2, 0.01 * (1 if i % 2 else -1)) for i in range(40)]
    table = spark.createDataFrame(rows, "k string, datetime timestamp, pred_prob_up double, future_excess_return double")
    free = th.optimize_validation(table, ["k"], Costs(borrow_bps_per_day=0.0)).first()
    assert free == th.optimize_validation(table, ["k"], Costs(borrow_bps_per_day=500.0)).first()


def test_long_histories_take_time_in_proportion(spark):
    def took(n):
        frame = spark.range(n).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("datetime"), F.rand(3).alias("v"))
        out = Rolling(frame, by_symbol(), {"v": Series(F.col("v"))}, (20,))
        start = time.perf_counter()
        out.select({"z": out.z("v", 20, 5)}).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took(1000)
    assert took(40_000) < 4 * max(took(10_000), 0.5)
