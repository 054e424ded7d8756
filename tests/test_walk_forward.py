"""Walk forward: rows of each window, skipped fits, trades with costs, curves and portfolio."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barweave.operators import labels as lb, learn as ml, patterns as pt, signals as sg, walkforward as wf

T0 = dt.datetime(2024, 1, 1)
COSTS = sg.Costs(fee_bps=1.0, spread_bps=0.0, slippage_bps=0.0, borrow_bps_per_day=1.0)
SMALL = ml.LearnerSize(rounds=2, trees=3, depth=2, folds=2, fast=True)


def day(n):
    return T0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def frame(spark):
    """Two symbols over 40 days, every row a doji, 20 days of B also a hammer; the label follows x."""
    rows = []
    for i in range(40):
        for s in ("A", "B"):
            up = (i * 7 + ord(s)) % 3 != 0
            rows.append((s, day(i), 100.0 + i % 5 + (s == "B"), 1.0 if up else -1.0, int(up), 0.01 if up else -0.01, 1, int(s == "B" and i < 20), "doji", "train"))
    names = "symbol string, datetime timestamp, close double, x double, future_direction int, future_excess_return double, pattern_doji int, pattern_hammer int, pattern string, split string"
    frame = spark.createDataFrame(rows, names).withColumns({"future_return": F.col("future_excess_return"), "volatility_20": F.lit(0.1)})
    return frame.withColumns({pt.pattern_column(p): F.lit(0) for p in pt.PATTERNS if p not in ("doji", "hammer")})


def by_x(train, test):
    assert {r.role for r in train.select("role").distinct().collect()} == {"train"}
    return test.withColumn("pred_prob_up", 0.5 + F.col("x") * 0.3).withColumn("position", F.col("x").cast("int"))


@pytest.fixture(scope="module")
def result(spark, frame):
    windows = lb.walk_forward_windows(frame, 10, 10, 5)  # test parts from days 10, 20 and 30; the last date is 39
    return wf.walk_forward(frame, windows, by_x, ml.TrainConfig(costs=COSTS, embargo_bars=1), min_rows=10, workers=3)


def test_each_window_and_pattern_is_fitted_or_says_why(result):
    got = {(r.window_no, r.pattern): (r.train_rows, r.test_rows, r.skipped_because) for r in result.fits.collect()}
    # labels end two bars on: the last training day's label must be known before the embargoed start, a test label in the window
    assert got[(0, "doji")] == (2 * 9, 2 * 7, None) and got[(1, "doji")] == (2 * 9, 2 * 7, None)
    assert got[(0, "hammer")] == (9, 7, "fewer than 10 training rows") and got[(1, "hammer")][2] == "fewer than 10 training rows"
    assert set(got) <= {(w, p) for w in range(3) for p in ("doji", "hammer")}


def test_trades_carry_costs_and_stay_inside_their_windows(result, frame):
    closes = {(r.symbol, r.datetime): r.close for r in frame.collect()}
    trades = result.trades.collect()
    assert len({(r.pattern, r.symbol, r.datetime) for r in trades}) == len(trades) == 2 * 7 * 3
    for r in trades:
        start = {11: 11, 21: 21, 31: 31}[(r.window_start - T0).days]
        assert start <= (r.datetime - T0).days < start + 7
        gross = closes[(r.symbol, r.datetime + dt.timedelta(days=1))] / closes[(r.symbol, r.datetime)] - 1.0
        assert abs(r.strategy_return - (r.position * gross - 1e-4 - (1e-4 if r.position < 0 else 0))) < 1e-12


def test_summary_and_curves(result):
    (row,) = result.summary.collect()
    assert (row.pattern, row.model_file, row.windows_used, row.trades) == ("doji", "walk_forward_retrain", 3, 42)
    assert (row.start_datetime, row.end_datetime) == (day(11), day(37))
    curves = result.curves().collect()
    dates = {day(s + i) for s in (11, 21, 31) for i in range(7)}
    for variant in ("ml_model", "baseline_blind_pattern", "baseline_universe_eqw"):
        assert {r.datetime for r in curves if r.curve_variant == variant} == dates
    growth = 1.0
    for r in sorted((r for r in curves if r.curve_variant == "ml_model"), key=lambda r: r.datetime):
        growth *= 1 + r.period_return
        assert abs(r.equity_value - 10_000 * growth) < 1e-6


def test_portfolio_of_the_walk(result):
    every = wf.walk_forward_portfolio(result, COSTS, top_k=1)
    dates = {r.datetime for r in every.collect()}
    assert dates and dates <= {r.datetime for r in result.trades.select("datetime").collect()}
    best = wf.walk_forward_portfolio(result, COSTS, best=2, min_trades=40, min_win_rate=0.0, top_k=1)
    assert {r.datetime for r in best.collect()} == dates
    assert wf.walk_forward_portfolio(result, COSTS, best=2, min_trades=43, min_win_rate=0.0).count() == 0


def test_retrained_models_take_one_class_in_a_test_part(spark, frame):
    config = ml.TrainConfig(min_rows=10, size=SMALL, costs=COSTS, meta_filter=False)
    late = frame.withColumn("future_direction", F.when(F.col("datetime") >= F.lit(day(10)), 1).otherwise(F.col("future_direction")))
    windows = lb.walk_forward_windows(late, 10, 10, 10).where("window_no = 0")
    out = wf.walk_forward(late, windows, wf.retrain(["x"], config), config, ["doji"], min_rows=10)
    assert [r.skipped_because for r in out.fits.collect()] == [None] and out.scored.count() == 2 * 9  # the label of the last day ends outside
    assert out.scored.where("pred_prob_up IS NULL").count() == 0


def test_no_window_and_no_model_give_empty_tables(spark, frame):
    none = wf.walk_forward(frame, lb.walk_forward_windows(frame, 100, 10, 10), by_x, ml.TrainConfig(costs=COSTS))
    assert [none.fits.count(), none.scored.count(), none.trades.count(), none.summary.count(), none.periods.count()] == [0] * 5
    refused = wf.walk_forward(frame, lb.walk_forward_windows(frame, 10, 10, 10), lambda train, test: "no", ml.TrainConfig(costs=COSTS), ["doji"], 1)
    assert {r.skipped_because for r in refused.fits.collect()} == {"no"} and refused.trades.count() == 0


def test_an_error_of_a_fit_is_raised(spark, frame):
    def broken(train, test):
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        wf.walk_forward(frame, lb.walk_forward_windows(frame, 10, 10, 10), broken, ml.TrainConfig(costs=COSTS), ["doji"], 1)
