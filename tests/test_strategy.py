import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import learn as ml, membership as mb, portfolio as pf, signals as sg, spreads as sp, thresholds as th, valuation as va
from barweave.functions import text as tx

FREE = sg.Costs(0, 0, 0, 0)


def stamp(c):
    return F.col(c).cast("timestamp").alias(c)


def test_compounding_by_date(spark):
    rows = spark.createDataFrame(
        [("m", d, s, 0.1) for d in ("2024-01-01", "2024-01-02") for s in ("A", "B")], "model string, datetime string, symbol string, strategy_return double"
    ).select("model", stamp("datetime"), "symbol", "strategy_return")
    row = sg.summary(rows, ["model"]).first()
    assert row.trades == 4 and row.cumulative_return == pytest.approx(0.21)
    assert row.sharpe == 0.0 and row.profit_factor is None and row.max_drawdown == 0.0


def test_drawdown_starts_at_the_first_period(spark):
    rows = spark.createDataFrame([("m", f"2024-01-0{i + 1}", r) for i, r in enumerate([-0.5, 0.2, -0.1])], "m string, datetime string, period_return double")
    row = sg.period_metrics(rows.select("m", stamp("datetime"), "period_return"), ["m"]).first()
    assert row.max_drawdown == pytest.approx(-0.1)


def test_short_side_wins_overlap(spark):
    out = spark.range(1).select(sg.position(F.lit(0.5), F.lit(0.4), F.lit(0.6)).alias("p")).first()
    assert out.p == -1


def test_position_cap_leaves_cash(spark):
    rows = [(d, s, sc, 0.10, 0.2) for d in ("2024-01-01", "2024-01-02", "2024-01-03") for s, sc in (("A", 0.3),)]
    signals = spark.createDataFrame(rows, "datetime string, symbol string, score double, realized_return double, volatility_20 double").withColumn("datetime", F.col("datetime").cast("timestamp"))
    trades = pf.portfolio_trades(signals, FREE, top_k=1, max_symbol_weight=0.20)
    row = pf.portfolio_summary(trades).first()
    assert row.avg_trade_return == pytest.approx(0.02)
    assert row.cumulative_return == pytest.approx(1.02**3 - 1)
    assert pf.portfolio_trades(signals, FREE, max_gross=0.0).count() == 0


def test_min_gap(spark):
    signals = spark.createDataFrame([("A", f"2024-01-{d:02d}", 0.1, 0.0, 0.1) for d in range(1, 9)], "symbol string, datetime string, score double, realized_return double, volatility_20 double").withColumn("datetime", F.col("datetime").cast("timestamp"))
    kept = [r.datetime.day for r in pf.spaced_signals(signals, 2).orderBy("datetime").collect()]
    assert kept == [1, 4, 7]


def test_intervals_from_change_log(spark):
    changes = spark.createDataFrame(
        [("2020-01-01", "CCC", "AAA"), ("2018-06-01", "AAA", "BBB")], "effective_date string, added string, removed string"
    ).withColumn("effective_date", F.col("effective_date").cast("timestamp"))
    current = spark.createDataFrame([("CCC",)], "symbol string")
    rows = {r.symbol: (str(r.start_date.date()), str(r.end_date.date())) for r in mb.intervals_from_changes(changes, current, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert rows == {"CCC": ("2020-01-01", "2024-01-01"), "AAA": ("2018-06-01", "2020-01-01"), "BBB": ("1900-01-01", "2018-06-01")}


def test_membership_is_half_open(spark):
    bars = spark.createDataFrame([("A", f"2024-01-0{d}") for d in range(1, 5)], "symbol string, datetime string").withColumn("datetime", F.col("datetime").cast("timestamp"))
    iv = spark.createDataFrame([("A", "2024-01-01", "2024-01-02"), ("A", "2024-01-04", "2024-01-05")], "symbol string, start_date string, end_date string")
    iv = iv.select("symbol", stamp("start_date"), stamp("end_date"))
    assert [r.datetime.day for r in mb.filter_by_membership(bars, iv).orderBy("datetime").collect()] == [1, 4]
    assert mb.filter_by_membership(bars, iv.limit(0)).count() == 4
    assert mb.filter_by_membership(bars, iv.withColumn("end_date", F.col("start_date"))).count() == 0


def test_threshold_grid_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": "m", "datetime": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 20, 400), unit="D"),
                        "pred_prob_up": rng.uniform(0.2, 0.8, 400), "r": rng.normal(0, 0.02, 400)})
    costs = sg.Costs(1, 0, 0, 0)
    out = th.pair_periods(spark.createDataFrame(pdf), ["k"], (0.55, 0.6), (0.4, 0.45), costs, "r").toPandas()
    for lt, st in itertools.product((0.55, 0.6), (0.4, 0.45)):
        pos = np.where(pdf.pred_prob_up >= lt, 1, np.where(pdf.pred_prob_up <= st, -1, 0))
        want = (pos * pdf.r - 0.0001)[pos != 0].groupby(pdf.datetime[pos != 0]).mean()
        got = out[(out.long_threshold == lt) & (out.short_threshold == st)].set_index("datetime")["period_return"].sort_index()
        np.testing.assert_allclose(got.to_numpy(), want.sort_index().to_numpy(), rtol=1e-9)


def test_default_thresholds_without_enough_trades(spark):
    rows = spark.createDataFrame([("m", "2024-01-01", 0.9, 0.1)], "k string, datetime string, pred_prob_up double, future_excess_return double").withColumn("datetime", F.col("datetime").cast("timestamp"))
    best = th.optimize_validation(rows, ["k"], FREE).first()
    assert (best.long_threshold, best.short_threshold, best.trades) == (0.55, 0.45, 0)


def test_recommendation_defaults_and_weights(spark):
    schema = "roc_auc double, train_rows bigint, tuned_long_threshold double, tuned_short_threshold double"
    empty = th.recommend(spark.createDataFrame([], schema)).first()
    assert (empty.recommended_long_threshold, empty.recommended_short_threshold) == (0.65, 0.35)
    row = th.recommend(spark.createDataFrame([(0.6, 1000, 0.62, 0.38), (0.52, 500, 0.64, 0.36)], schema)).first()
    assert 0.60 <= row.recommended_long_threshold <= 0.64 and 0.36 <= row.recommended_short_threshold <= 0.40


def test_neutral_weights(spark):
    pairs = spark.createDataFrame([(1.0, 3.0, None, None)], "long_beta double, short_beta double, long_component_size_z double, short_component_size_z double")
    row = sp.neutral_weights(pairs, True, True).first()
    assert (row.long_weight, row.short_weight) == (0.75, 0.25)


def test_net_objective_matches_trade_order(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"datetime": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(60) // 6, unit="D"), "symbol": np.arange(60) % 6, "strategy_return": rng.normal(0, 0.05, 60)})
    row = ml.net_objective(spark.createDataFrame(pdf), []).first()
    growth = np.exp(np.log1p(pdf.strategy_return).cumsum())
    assert row.drawdown_score == pytest.approx(-abs((growth / growth.cummax() - 1).min()))
    assert row.cumulative_return == pytest.approx(growth.iloc[-1] - 1)


def test_calibration_needs_rows_and_classes(spark):
    few = spark.createDataFrame([(0.4, 1)] * 10, "prob_raw double, future_direction int")
    assert not ml.fit_calibration(few).fitted
    rows = spark.createDataFrame([(i / 200, int(i % 200 > 120)) for i in range(200)], "prob_raw double, future_direction int")
    curve = ml.fit_calibration(rows)
    out = rows.select(curve.apply(F.col("prob_raw")).alias("p")).agg(F.min("p"), F.max("p")).first()
    assert curve.fitted and curve.coef > 0 and 0 < out[0] < out[1] < 1


def test_roc_auc_and_counts(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0)], "p double, y int")
    m = ml.binary_metrics(rows, [], "y", "p").first()
    assert m.roc_auc == pytest.approx(0.75) and m.accuracy == pytest.approx(0.75) and m.recall == 1.0


def test_impute_medians_and_empty_columns(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (3.0, None)], "a double, b double")
    out = ml.impute(rows, ["a", "b"]).collect()
    assert out[1].a == 3.0 and all(r.b == 0.0 for r in out)


def test_growth_stops_at_the_first_gap(spark):
    rows = spark.createDataFrame([("A", y, v) for y, v in ((2020, 100.0), (2021, -5.0), (2022, 110.0), (2023, 121.0))], "symbol string, date int, revenue double")
    row = va.geometric_growth(rows, "revenue", "revenue").first()
    assert row.revenue_growth == pytest.approx(0.1) and row.revenue_years == 1


def test_text(spark):
    t = spark.createDataFrame([("$1,001 - $15,000", "3.5B", "brk.b", "Strong Buy"), ("none", "12%", "nan", "Hold")], "a string, n string, s string, g string")
    out = t.select(tx.parse_amount_range(F.col("a")).alias("a"), tx.parse_number(F.col("n")).alias("n"), tx.strict_symbol(F.col("s")).alias("s"), tx.grade_score(F.col("g")).alias("g")).collect()
    assert (out[0].a.low, out[0].a.high, out[0].a.mid) == (1001.0, 15000.0, 8000.5) and out[1].a is None
    assert (out[0].n, out[1].n) == (3.5e9, 0.12)
    assert (out[0].s, out[1].s) == ("BRK-B", None) and (out[0].g, out[1].g) == (2.0, 0.0)


def test_beta_looks_back_a_bounded_time(spark):
    """Twice the benchmark lately, its opposite before; the look-back decides, and symbols without a recent bar have beta 1."""
    import datetime as dt

    from barweave.operators import valuation as va

    rows, level, price = [], 100.0, 100.0
    for m in range(60):
        step = 0.02 if m % 3 else -0.03
        level *= 1 + step
        price *= 1 + (2 * step if m >= 36 else -step)
        rows.append((m, dt.datetime(2018 + m // 12, m % 12 + 1, 20), level, price))
    bench = spark.createDataFrame([("B", d, b) for _, d, b, _ in rows], "symbol string, datetime timestamp, close double")
    bars = spark.createDataFrame([("A", d, p) for _, d, _, p in rows] + [("old", d, p) for m, d, _, p in rows if m < 24], bench.schema)
    recent = {r.symbol: r.beta for r in va.monthly_beta(bars, bench, days=700).collect()}
    assert abs(recent["A"] - 2.0) < 1e-9 and recent["old"] == 1.0
    whole = {r.symbol: r.beta for r in va.monthly_beta(bars, bench).collect()}
    assert whole["A"] < 1.5 and abs(whole["old"] + 1.0) < 1e-9
    then = {r.symbol: r.beta for r in va.monthly_beta(bars, bench, F.lit("2020-12-31").cast("timestamp"), 700).collect()}
    assert abs(then["A"] + 1.0) < 1e-9
