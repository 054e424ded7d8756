import datetime as dt

import pytest
from pyspark.sql import functions as F

from barweave.operators import patterns as pt
from barweave.sources import bars as sb


def test_two_bar_bearish_engulfing(bars):
    frame = pt.add_patterns(bars(("ABC", [(10, 11.5, 9.5, 11), (11.2, 11.3, 9.1, 9.2)])))
    last = frame.orderBy(F.desc("datetime")).first()
    assert last.pattern_bearish_engulfing == 1
    assert last.pattern == "bearish_engulfing"


def test_single_bar_doji_and_first_bar_has_no_two_bar_pattern(bars):
    row = pt.add_patterns(bars(("XYZ", [(10, 10.5, 9.5, 10.02)]))).first()
    assert row.pattern_doji == 1
    assert row.pattern_bullish_engulfing == 0 and row.pattern_piercing_line == 0


def test_flat_bar_is_not_a_doji(bars):
    row = pt.add_patterns(bars(("XYZ", [(10, 10, 10, 10)]))).first()
    assert row.pattern_doji == 0 and row.pattern is None


def test_unknown_pattern(bars):
    frame = pt.add_patterns(bars(("XYZ", [(10, 10.5, 9.5, 10.02)])))
    with pytest.raises(ValueError):
        pt.pattern_hits(frame, "nope")
    assert pt.pattern_subset(frame, "nope").count() == 0


def test_fan_out_counts_every_flag(bars):
    frame = pt.add_patterns(bars(("ABC", [(10, 11.5, 9.5, 11), (11.2, 11.3, 9.1, 9.2), (5, 6, 4, 5.9)])))
    names = [r.member for r in pt.fan_out(frame).collect()]
    assert "bearish_engulfing" in names and "none" in names


def test_adjusted_close_scales_prices(spark):
    raw = spark.createDataFrame(
        [("A", "2024-01-02", 52.0, 55.0, 50.0, 50.0, 25.0, 10.0), ("A", "2024-01-01", 50.0, 52.0, 49.0, 51.0, 51.0, 9.0), ("A", "bad", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
        "symbol string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double",
    )
    rows = sb.normalize_bars(raw).orderBy("datetime").collect()
    assert len(rows) == 2
    assert (rows[0].open, rows[0].close) == (50.0, 51.0)
    assert (rows[1].open, rows[1].high, rows[1].low, rows[1].close) == (26.0, 27.5, 25.0, 25.0)


def test_normalize_requires_columns(spark):
    with pytest.raises(ValueError):
        sb.normalize_bars(spark.createDataFrame([("A", 1.0)], "symbol string, close double"))


def test_lookback_clip(spark):
    days = spark.range(1200).select(
        F.lit("A").alias("symbol"), F.expr("timestamp'2024-01-01' - make_dt_interval(id)").cast("timestamp").alias("datetime")
    )
    kept = sb.clip_years(days, 1, F.lit("2024-01-01").cast("date"))
    assert kept.count() == 366
    assert kept.agg(F.min("datetime")).first()[0] == dt.datetime(2023, 1, 1)


def test_bars_do_not_depend_on_the_skew_of_symbols(spark):
    prints = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("s"),
        (F.col("id") % 20).alias("d"),
        F.col("id"),
        (F.col("id") * 7 % 101).cast("double").alias("p"),
    )
    made = sb.build_bars(prints, F.col("s"), F.col("d"), F.col("p"), [F.col("id")]).toPandas()
    plain = prints.toPandas().sort_values("id").groupby(["s", "d"]).agg(open=("p", "first"), close=("p", "last"), high=("p", "max"), volume=("p", "size"))
    got = made.set_index(["symbol", "datetime"]).sort_index()
    plain.index.names = ["symbol", "datetime"]
    plain = plain.sort_index()
    for c in ("open", "close", "high", "volume"):
        assert (got[c] == plain[c]).all()


def test_bar_store_roundtrip(spark, bars, tmp_path):
    frame = bars(("A", [(1, 2, 0.5, 1.5)] * 3))
    sb.save_bars(frame, str(tmp_path / "store"), "1d")
    assert sb.scan_bars(spark, str(tmp_path / "store"), "1d", ["A"]).count() == 3
    assert sb.scan_bars(spark, str(tmp_path / "store"), "1h").count() == 0
