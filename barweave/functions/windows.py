"""Rolling helpers.

Every rolling statistic counts its non-null inputs and stays NULL until
``min_periods`` of them lie in the frame.  All helpers take a ready window, so
the caller keeps one partitioning and one ordering and Spark plans a single
exchange and sort for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from barweave.functions.missing import flag, ratio

DAY_MICROS = 86_400_000_000


def by_symbol(*keys: str, order: str = "datetime") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def guarded(value: Column, x: Column, frame: WindowSpec, min_periods: int) -> Column:
    return F.when(F.count(x).over(frame) >= min_periods, value)


def roll(fn, x: Column, w: WindowSpec, n: int, min_periods: int) -> Column:
    """``fn`` (F.avg, F.sum, F.max, ...) over the last ``n`` rows."""
    frame = last_rows(w, n)
    return guarded(fn(x).over(frame), x, frame, min_periods)


def roll_mean(x, w, n, min_periods):
    return roll(F.avg, x, w, n, min_periods)


def roll_sum(x, w, n, min_periods):
    return roll(F.sum, x, w, n, min_periods)


def roll_std(x, w, n, min_periods):
    return roll(F.stddev_samp, x, w, n, max(2, min_periods))


def roll_median(x, w, n, min_periods):
    return roll(lambda c: F.percentile(c, F.lit(0.5)), x, w, n, min_periods)


def roll_z(x: Column, w: WindowSpec, n: int, min_periods: int) -> Column:
    frame = last_rows(w, n)
    z = ratio(x - F.avg(x).over(frame), F.stddev_samp(x).over(frame))
    return guarded(z, x, frame, max(2, min_periods))


def pct_change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return ratio(x, F.lag(x, n).over(w)) - 1.0


def time_frame(keys: list[str], time_col: str, days: int) -> WindowSpec:
    """Half-open ``(t - days, t]`` frame on event time."""
    return (
        Window.partitionBy(*keys)
        .orderBy(F.unix_micros(F.col(time_col)))
        .rangeBetween(-days * DAY_MICROS + 1, 0)
    )


def run_length(hit: Column, reset: Column, island: str, w_keys: list[str], order: str = "datetime") -> Column:
    """Running count of ``hit`` inside the island numbered by column ``island``."""
    w = running(Window.partitionBy(*w_keys, island).orderBy(order))
    return F.sum(flag(hit)).over(w)


def island_number(reset: Column, w: WindowSpec) -> Column:
    return F.sum(flag(reset)).over(running(w))
