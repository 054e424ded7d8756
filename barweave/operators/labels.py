"""Forward-return labels, chronological splits, purge and walk-forward windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.tables import pct_rank, settle
from barweave.functions.windows import by_symbol

# How many bars of an interval make a trading day, and a bar's clock length.
BARS_PER_DAY = {"1d": 1.0, "1h": 6.5, "60m": 6.5, "30m": 13.0, "15m": 26.0, "5m": 78.0, "1m": 390.0}
BAR_MINUTES = {"1d": 1440, "1h": 60, "60m": 60, "30m": 30, "15m": 15, "5m": 5, "1m": 1}


def label_price(frame: DataFrame) -> Column:
    return F.col("adj_close") if "adj_close" in frame.columns else F.col("close")


def add_future_return(frame: DataFrame, horizon: int = 1) -> DataFrame:
    price = label_price(frame)
    return frame.withColumn(
        "future_return", F.try_divide(F.lead(price, max(1, horizon)).over(by_symbol()), price) - 1.0
    )


def add_market_labels(frame: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """future_market_return and future_excess_return against the mean of the date.

    The mean is a grouped aggregate joined back, not a window over the date, so
    a wide cross-section is combined map-side.  ``bars`` may name a cheaper
    source of the same returns, so that a long plan is not run once more.
    """
    market = (frame if bars is None else bars).groupBy("datetime").agg(F.avg("future_return").alias("future_market_return"))
    return (
        frame.join(settle(market), "datetime", "left")
        .withColumn("future_excess_return", F.col("future_return") - F.col("future_market_return"))
        .select(*frame.columns, "future_market_return", "future_excess_return")
    )


def add_rank_label(frame: DataFrame) -> DataFrame:
    return pct_rank(frame, "datetime", "future_return", "future_rank_pct")


def direction(mode: str = "excess", threshold: float = 0.0) -> Column:
    """0/1 label; ``absolute``, ``cross_sectional`` or (also for unknown modes) ``excess``."""
    if mode == "absolute":
        source, cut = F.col("future_return"), threshold
    elif mode == "cross_sectional":
        source, cut = F.col("future_rank_pct"), threshold if 0.0 <= threshold <= 1.0 else 0.5
    else:
        source, cut = F.col("future_excess_return"), threshold
    return F.when(source.isNotNull(), (source > cut).cast("int"))


def add_labels(frame: DataFrame, horizon: int = 1, mode: str = "excess", threshold: float = 0.0) -> DataFrame:
    labeled = add_rank_label(add_market_labels(add_future_return(frame, horizon)))
    return labeled.withColumn("future_direction", direction(mode, threshold))


def drop_unlabeled(frame: DataFrame) -> DataFrame:
    return frame.dropna(subset=["future_return", "future_direction"])


def split_cutoff(frame: DataFrame, train_share: float = 0.8) -> DataFrame:
    """One row ``cutoff``: the first test date; NULL with fewer than two dates.

    Works on the distinct dates only, which the calendar bounds.
    """
    dates = frame.select("datetime").where(F.col("datetime").isNotNull()).distinct()
    w = Window.orderBy("datetime")  # one row per date
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = dates.select(
        "datetime", (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(whole).alias("_n")
    )
    at = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * train_share), F.col("_n") - 1))
    return numbered.where((F.col("_n") >= 2) & (F.col("_i") == at)).agg(F.min("datetime").alias("cutoff"))


def chronological_split(frame: DataFrame, train_share: float = 0.8, dates: DataFrame | None = None) -> DataFrame:
    """``split`` = train / test by date; rows of one date never straddle the cut.

    With fewer than two dates there is no cut, and the last rows by symbol are
    the test part.

    ``dates`` may name a cheaper source of the same dates, so that a long plan
    is not run once more just to find the cut.
    """
    cut = F.broadcast(settle(split_cutoff(frame if dates is None else dates, train_share)))  # one row
    if cut.first()["cutoff"] is None:
        return single_date_split(frame, train_share)
    dated = frame.crossJoin(cut).withColumn(
        "split", F.when(F.col("datetime") >= F.col("cutoff"), "test").otherwise("train")
    )
    return dated.drop("cutoff")


def single_date_split(frame: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Fallback for fewer than two dates: the last rows by symbol are the test part."""
    place = F.percent_rank().over(Window.partitionBy("datetime").orderBy("symbol"))
    return frame.withColumn("split", F.when(place >= train_share, "test").otherwise("train"))


def split_at(frame: DataFrame, date: str) -> DataFrame:
    """``datetime >= date`` is test; an unreadable date raises at planning time."""
    import datetime as dt

    parsed = dt.datetime.fromisoformat(str(date).strip().replace("Z", "+00:00"))
    instant = F.lit(parsed.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return frame.withColumn("split", F.when(F.col("datetime") >= instant, "test").otherwise("train"))


def add_label_end(frame: DataFrame, bars_ahead: int = 1) -> DataFrame:
    """When the label of a row becomes known (on all bars of the symbol)."""
    return frame.withColumn("label_end_datetime", F.lead("datetime", max(1, bars_ahead)).over(by_symbol()))


def purge(train: DataFrame, test_start: Column) -> DataFrame:
    """Drop training rows whose label reaches into the test period (or is unknown)."""
    return train.where(F.col("label_end_datetime") < test_start)


def embargoed(test_start: Column, interval: str, bars: int) -> Column:
    minutes = BAR_MINUTES.get(interval.strip().lower(), 1440) * max(0, bars)
    return F.timestamp_add("MINUTE", F.lit(minutes), test_start)


def walk_forward_windows(
    frame: DataFrame, train_days: int, test_days: int, step_days: int, keep_last: int | None = None
) -> DataFrame:
    """One row per window: number, train_start, test_start, test_end.

    Test parts never overlap: the step is raised to the test length.  A window
    starts before the last date.
    """
    step = max(step_days, test_days)
    span = frame.agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi"))
    first = F.timestamp_add("DAY", F.lit(train_days), F.col("lo"))
    starts = span.where(first <= F.col("hi")).select(
        F.explode(F.sequence(first, F.col("hi"), F.expr(f"INTERVAL {step} DAYS"))).alias("test_start"), "hi"
    )
    starts = starts.where(F.col("test_start") < F.col("hi")).select("test_start")
    windows = starts.select(
        (F.row_number().over(Window.orderBy("test_start")) - 1).alias("window_no"),
        F.timestamp_add("DAY", F.lit(-train_days), F.col("test_start")).alias("train_start"),
        "test_start",
        F.timestamp_add("DAY", F.lit(test_days), F.col("test_start")).alias("test_end"),
    )
    if keep_last:
        newest = windows.orderBy(F.desc("window_no")).limit(keep_last)
        return newest
    return windows


def assign_windows(frame: DataFrame, windows: DataFrame, embargo_interval: str = "1d", embargo_bars: int = 0) -> DataFrame:
    """Rows with the windows they train or test in (``role``); purged and embargoed.

    A label must be known before the test part starts, or before it ends.  Each
    window is listed under the days it spans, so rows meet only the windows of
    their own day.
    """
    days = F.sequence(F.to_date("train_start"), F.to_date("test_end"), F.expr("INTERVAL 1 DAY"))
    windows = windows.withColumn("_day", F.explode(days))
    met = frame.withColumn("_day", F.to_date("datetime")).join(settle(windows), "_day").drop("_day")
    return with_roles(met, embargo_interval, embargo_bars)


def with_roles(met: DataFrame, embargo_interval: str = "1d", embargo_bars: int = 0) -> DataFrame:
    """Of rows beside a window those that train or test in it, with their ``role``."""
    start = embargoed(F.col("test_start"), embargo_interval, embargo_bars)
    t = F.col("datetime")
    is_test = (t >= start) & (t < F.col("test_end")) & (F.col("label_end_datetime") < F.col("test_end"))
    is_train = (t >= F.col("train_start")) & (t < F.col("test_start")) & (F.col("label_end_datetime") < start)
    role = F.when(is_test, "test").when(is_train, "train")
    return met.where(is_test | is_train).withColumn("role", role)
