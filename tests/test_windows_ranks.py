import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions.prefix import Rolling, Series
from barweave.functions.tables import keep_last, pct_rank
from barweave.functions.windows import by_symbol, time_frame
from barweave.operators import asof, base_features as bf, indicators as ti, labels as lb, recurrences as rc


@pytest.fixture
def walk(spark):
    rng = np.random.default_rng(5)
    parts = []
    for s in ("A", "B"):
        close = 50 + np.cumsum(rng.normal(0, 1, 260))
        parts.append(pd.DataFrame({"symbol": s, "datetime": pd.date_range("2020-01-01", periods=260), "close": close,
                                   "open": close + rng.normal(0, 0.3, 260), "high": close + 1.0, "low": close - 1.0,
                                   "volume": rng.integers(0, 5, 260).astype(float)}))
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf)


def test_prefix_moments_match_pandas(walk):
    pdf, df = walk
    x = F.nullif(F.col("volume"), F.lit(0.0))
    roll = Rolling(df, by_symbol(), {"v": Series(x), "c": Series(F.col("close"))}, (5, 50))
    out = roll.select({"s5": roll.std("v", 5, 2), "m50": roll.mean("c", 50, 16), "z50": roll.z("c", 50, 16)}).toPandas()
    out = out.sort_values(["symbol", "datetime"]).reset_index(drop=True)
    ref = pdf.sort_values(["symbol", "datetime"]).reset_index(drop=True)
    v = ref["volume"].replace(0, np.nan)
    g = lambda s, f: s.groupby(ref["symbol"]).transform(f)
    want = g(v, lambda s: s.rolling(5, min_periods=2).std())
    pd.testing.assert_series_equal(out["s5"], want, check_names=False, rtol=1e-9, atol=1e-9)
    mean = g(ref["close"], lambda s: s.rolling(50, min_periods=16).mean())
    std = g(ref["close"], lambda s: s.rolling(50, min_periods=16).std())
    pd.testing.assert_series_equal(out["m50"], mean, check_names=False, rtol=1e-9)
    pd.testing.assert_series_equal(out["z50"], (ref["close"] - mean) / std, check_names=False, rtol=1e-7)


def test_constant_window_has_no_zscore(bars):
    flat = bars(("A", [(10, 10, 10, 10.1)] * 30 + [(10, 10, 10, 11)]))
    out = bf.add_rolling(bf.add_shape(bf.add_returns(flat)), (5,)).orderBy("datetime").collect()
    assert out[20].z_close_5 is None and out[20].volatility_5 == 0.0
    assert out[30].z_close_5 == pytest.approx(1.7888543819998317)


def test_streaks(bars):
    closes = [1, 2, 3, 2, 1, 1, 2]
    out = bf.add_streaks(bf.add_returns(bars(("A", [(c, c, c, c) for c in closes])))).orderBy("datetime").collect()
    assert [r.up_streak for r in out] == [0, 1, 2, 0, 0, 0, 1]
    assert [r.down_streak for r in out] == [0, 0, 0, 1, 2, 0, 0]


def test_pct_rank_is_exact_with_ties_and_hot_dates(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"datetime": rng.choice([1, 1, 1, 2, 3], 4000), "x": rng.choice([0.0, 0.0, *rng.normal(size=300)], 4000)})
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).withColumn("id", F.monotonically_increasing_id())
    out = pct_rank(df, "datetime", "x", "r", slices=8).toPandas()
    want = out.groupby("datetime")["x"].rank(pct=True)
    pd.testing.assert_series_equal(out["r"], want, check_names=False, rtol=1e-12)
    assert len(out) == 4000


def test_half_open_time_frame(spark):
    rows = spark.createDataFrame([("A", "2024-01-01", 1.0), ("A", "2024-01-31", 10.0)], "symbol string, d string, v double")
    rows = rows.withColumn("d", F.col("d").cast("timestamp"))
    out = rows.withColumn("s", F.sum("v").over(time_frame(["symbol"], "d", 30))).orderBy("d").collect()
    assert [r.s for r in out] == [1.0, 10.0]


@pytest.mark.parametrize("bucket", [None, "month"])
def test_asof_takes_the_whole_newest_row(spark, bucket):
    left = spark.createDataFrame([("A", f"2024-0{m}-15") for m in range(1, 7)] + [("B", "2024-03-01")], "symbol string, datetime string")
    left = left.withColumn("datetime", F.col("datetime").cast("timestamp"))
    right = spark.createDataFrame(
        [("A", "2024-02-15", 100.0, 1.0), ("A", "2024-04-01", 200.0, None)], "symbol string, asof_datetime string, cap double, score double"
    ).withColumn("asof_datetime", F.col("asof_datetime").cast("timestamp"))
    out = asof.asof_join(left, right, ["symbol"], bucket=bucket).orderBy("symbol", "datetime").collect()
    assert [r.cap for r in out] == [None, 100.0, 100.0, 200.0, 200.0, 200.0, None]
    assert [r.score for r in out] == [None, 1.0, 1.0, None, None, None, None]


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k int, s int, v string")
    assert {(r.k, r.v) for r in keep_last(df, ["k"], [F.col("s")]).collect()} == {(1, "c"), (2, "z")}


def test_labels_two_symbols(bars):
    up = [(100 * 1.1**i,) * 4 for i in range(3)]
    down = [(100 * 0.9**i,) * 4 for i in range(3)]
    out = lb.add_labels(bars(("AAA", up), ("BBB", down)))
    rows = {(r.symbol, r.datetime.day): r for r in out.collect()}
    assert rows["AAA", 1].future_excess_return == pytest.approx(0.1)
    assert (rows["AAA", 1].future_direction, rows["BBB", 1].future_direction) == (1, 0)
    assert (rows["AAA", 1].future_rank_pct, rows["BBB", 1].future_rank_pct) == (1.0, 0.5)
    assert rows["AAA", 3].future_direction is None


def test_adjusted_close_wins_for_labels(bars, spark):
    frame = bars(("A", [(100,) * 4, (50,) * 4, (50,) * 4])).withColumn("adj_close", F.expr("CASE day(datetime) WHEN 3 THEN 110.0D ELSE 100.0D END"))
    first = lb.add_future_return(frame).orderBy("datetime").first()
    assert first.future_return == 0.0


def test_chronological_split(bars):
    frame = bars(("A", [(1,) * 4] * 10), ("B", [(1,) * 4] * 10))
    split = lb.chronological_split(frame)
    assert split.where("split = 'test'").select("datetime").distinct().count() == 2
    assert split.where("split = 'train'").agg(F.max("datetime")).first()[0] < split.where("split = 'test'").agg(F.min("datetime")).first()[0]


def test_split_at_rejects_bad_dates(bars):
    frame = bars(("A", [(1,) * 4] * 3))
    assert [r.split for r in lb.split_at(frame, "2024-01-02").orderBy("datetime").collect()] == ["train", "test", "test"]
    with pytest.raises(ValueError):
        lb.split_at(frame, "not a date")


def test_purge_drops_overlapping_label(bars):
    frame = lb.add_label_end(bars(("A", [(1,) * 4] * 8)), 1)
    cut = F.lit("2024-01-06").cast("timestamp")
    train = frame.where(F.col("datetime") < cut)
    assert train.count() - lb.purge(train, cut).count() == 1


def test_walk_forward_step_never_overlaps(bars):
    frame = bars(("A", [(1,) * 4] * 30))
    windows = lb.walk_forward_windows(frame, 10, 5, 1).orderBy("test_start").collect()
    assert len(windows) == 4
    assert all(a.test_end <= b.test_start for a, b in zip(windows, windows[1:]))


def test_moving_averages_match_pandas(walk):
    pdf, df = walk
    out = ti.add_moving_averages(df, (5, 50), (21,)).toPandas().sort_values(["symbol", "datetime"])
    ref = pdf.sort_values(["symbol", "datetime"])
    g = ref.groupby("symbol")["close"]
    weights = np.arange(1, 51)
    np.testing.assert_allclose(out["sma_50"], g.transform(lambda s: s.rolling(50).mean()), rtol=1e-9)
    np.testing.assert_allclose(out["wma_50"], g.transform(lambda s: s.rolling(50).apply(lambda w: (w * weights).sum() / weights.sum())), rtol=1e-9)


def test_recurrences_do_not_need_the_package_on_the_worker(walk):
    pdf, df = walk
    out = rc.add_recurrences(df).toPandas().sort_values(["symbol", "datetime"])
    ref = pdf.sort_values(["symbol", "datetime"]).groupby("symbol")["close"]
    np.testing.assert_allclose(out["ema_20"], ref.transform(lambda s: s.ewm(span=20, adjust=False, min_periods=20).mean()), rtol=1e-9)
    rsi = out["rsi_14"].dropna()
    assert ((rsi >= 0) & (rsi <= 100)).all()
    both = out["psar_up"].notna() & out["psar_down"].notna()
    assert not both.any()


def prints(spark, n=6000):
    """Raw prints: symbol 0 owns a third of them, half of its rows in one minute; symbol 9 has no right row."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        s = 0 if i % 3 == 0 else int(rng.integers(1, 10))
        minute = 5000 if s == 0 and i % 2 else int(rng.integers(0, 400_000))
        rows.append((i, s, None if i % 997 == 5 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), "kept"))
    return spark.createDataFrame(rows, "id long, symbol long, datetime timestamp, note string"), rows


def slow_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(s), dt.datetime(2023, 12, 1) + dt.timedelta(minutes=int(rng.integers(0, 420_000))), float(rng.integers(0, 99)) if rng.random() < 0.8 else None, "right") for s in range(9) for _ in range(1 if s == 8 else 40)]
    rows += [(0, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5000), None, "a"), (0, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5000), 7.0, "b"), (1, None, 1.0, "x")]
    return spark.createDataFrame(rows, "symbol long, asof_datetime timestamp, cap double, note string"), rows


@pytest.mark.parametrize("hot_rows, finest", [(1_000_000, 4096), (50, 7)])
def test_range_asof_equals_a_search(spark, hot_rows, finest):
    left, lrows = prints(spark)
    right, rrows = slow_rows(spark)
    got = {r.id: (r.symbol, r.datetime, r.note, r.asof_datetime, r.cap) for r in asof.asof_range(left, right, ["symbol"], hot_rows=hot_rows, finest=finest).collect()}
    assert len(got) == len(lrows)
    for i, s, t, note in lrows:
        before = [(u, (c is not None, c)) for k, u, c, _ in rrows if k == s and u is not None and t is not None and u <= t]
        u, c = max(before, default=(None, (False, None)))
        assert got[i] == (s, t, note, u, c[1])


def test_range_asof_sorts_no_print_and_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(asof, "HASHED_FROM", 10)
    left, lrows = prints(spark)
    right, _ = slow_rows(spark)
    out = asof.asof_range(left, right, ["symbol"], hot_rows=60)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan and "Window" not in plan and "NestedLoop" not in plan
    assert asof.asof_range(left.limit(0), right, ["symbol"]).count() == 0
    none = asof.asof_range(left, right.limit(0), ["symbol"])
    assert none.count() == len(lrows) and none.where("cap is not null or asof_datetime is not null").count() == 0


def test_moments_do_not_depend_on_the_history(spark):
    """A long walk of volumes near 1e9: the last windows agree with direct sums to twelve digits."""
    n = 300_000
    v = F.lit(1e9) + F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double") * 7.25 + F.when(F.col("id") > 200_000, 3e8).otherwise(0.0)
    frame = spark.range(n).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("datetime"), "id", F.when(F.col("id") % 1000 != 7, v).alias("v"))
    roll = Rolling(frame, by_symbol(), {"v": Series(F.col("v"), ramp=True)}, (20, 200, 500))
    out = {f"{k}_{m}": f for m in (20, 200, 500) for k, f in (("s", roll.total("v", m, 5)), ("d", roll.std("v", m, 5)), ("w", roll.weighted("v", m)))}
    got = roll.select(out).where("id >= 199000 and id < 202500 or id >= 297000").toPandas().sort_values("id").reset_index(drop=True)
    x = got.v.to_numpy()
    run = (got.id.diff().fillna(1) != 1).cumsum()
    for m in (20, 200, 500):
        for i in range(0, len(got), 37):
            if i < m or run[i] != run[i - m + 1]:
                continue
            part = x[i - m + 1 : i + 1].astype(np.longdouble)
            known = part[~np.isnan(part)]
            assert abs(got[f"s_{m}"][i] / float(known.sum()) - 1) < 1e-12
            assert abs(got[f"d_{m}"][i] / float(known.std(ddof=1)) - 1) < 1e-10
            if len(known) == m:
                want = float((part * np.arange(1, m + 1)).sum() / (m * (m + 1) / 2))
                assert abs(got[f"w_{m}"][i] / want - 1) < 1e-12
            else:
                assert np.isnan(got[f"w_{m}"][i])
