"""Market-wide context, betas, cross-sectional ranks and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from barweave.functions.missing import flag_double, ratio
from barweave.functions.tables import pct_ranks, settle
from barweave.functions.windows import (
    by_symbol, guarded, last_rows, pct_change, roll, roll_mean, roll_median, roll_std, roll_sum,
)

# Look-backs of the market table.
MARKET_RETURN_BARS = (1, 5, 10, 20, 63)
REGIME_MEDIAN_BARS = 252


def market_table(frame: DataFrame) -> DataFrame:
    """One row per date: mean close, breadth, dispersion and the rolling features on top.

    The cross-section is aggregated first, so the window without a key only
    ever sees the trading calendar.
    """
    r = F.col("ret_1")
    daily = frame.groupBy("datetime").agg(
        F.avg("close").alias("market_close"),
        F.avg(F.coalesce(r > 0, F.lit(False)).cast("double")).alias("breadth_up_share_1"),
        F.avg(F.coalesce(r < 0, F.lit(False)).cast("double")).alias("breadth_down_share_1"),
        F.stddev_samp(r).alias("cross_section_dispersion_1"),
    )
    w = Window.orderBy("datetime")
    mc = F.col("market_close")
    out = daily.withColumns({f"market_return_{n}": pct_change(mc, w, n) for n in MARKET_RETURN_BARS})
    mr = F.col("market_return_1")
    out = out.withColumns(
        {
            "market_volatility_20": roll_std(mr, w, 20, 5),
            "market_volatility_63": roll_std(mr, w, 63, 15),
            "market_trend_20": ratio(mc, roll_mean(mc, w, 20, 5)) - 1.0,
            "market_drawdown_63": ratio(mc, roll(F.max, mc, w, 63, 10)) - 1.0,
            "breadth_momentum_20": roll_mean(F.col("breadth_up_share_1"), w, 20, 5),
        }
    )
    vol, trend = F.col("market_volatility_20"), F.col("market_trend_20")
    usual = F.col("_usual_vol")
    return (
        out.withColumn("_usual_vol", roll_median(vol, w, REGIME_MEDIAN_BARS, 30))
        .withColumns(
            {
                "regime_low_vol_uptrend": flag_double((trend > 0) & (vol <= usual)),
                "regime_high_vol_downtrend": flag_double((trend < 0) & (vol > usual)),
            }
        )
        .drop("_usual_vol")
    )


def add_market_context(frame: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Join the market table back to every bar of its date."""
    table = market_table(frame) if market is None else market
    return frame.join(settle(table), "datetime", "left")


def add_alpha(frame: DataFrame) -> DataFrame:
    """Own minus market returns (only lengths both sides have) and the breadth edge."""
    have = set(frame.columns)
    out = {
        f"alpha_ret_{n}": F.col(f"ret_{n}") - F.col(f"market_return_{n}")
        for n in (5, 10, 20)
        if {f"ret_{n}", f"market_return_{n}"} <= have
    }
    if {"ret_1", "breadth_up_share_1"} <= have:
        out["breadth_edge_1"] = flag_double(F.col("ret_1") > 0) - F.col("breadth_up_share_1")
    return frame.withColumns(out)


def rolling_beta(stock, market, w, n: int, min_periods: int):
    """Pairwise covariance over the frame against the variance of the market alone."""
    frame = last_rows(w, n)
    both = F.when(stock.isNotNull() & market.isNotNull(), F.lit(1))
    cov = guarded(F.covar_samp(stock, market).over(frame), both, frame, min_periods)
    var = guarded(F.var_samp(market).over(frame), market, frame, min_periods)
    return ratio(cov, var)


def add_betas(frame: DataFrame) -> DataFrame:
    w = by_symbol()
    r, m = F.col("ret_1"), F.col("market_return_1")
    out = frame.withColumns({"beta_63": rolling_beta(r, m, w, 63, 20), "beta_20": rolling_beta(r, m, w, 20, 10)})
    out = out.withColumn("idiosyncratic_return_1", r - F.col("beta_63") * m)
    own = F.col("idiosyncratic_return_1")
    return out.withColumns(
        {"idiosyncratic_vol_20": roll_std(own, w, 20, 5), "idiosyncratic_momentum_20": roll_sum(own, w, 20, 5)}
    )


def add_flow_shock(frame: DataFrame) -> DataFrame:
    from barweave.functions.windows import roll_z

    return frame.withColumn("flow_shock_20", roll_z(F.col("dollar_volume"), by_symbol(), 20, 5))


def add_cross_ranks(frame: DataFrame, names: tuple[str, ...] = ("ret_5", "ret_20", "volatility_20")) -> DataFrame:
    """cs_rank_<name> for every listed column that is present."""
    return pct_ranks(frame, "datetime", {n: f"cs_rank_{n}" for n in names if n in frame.columns})


def add_calendar(frame: DataFrame) -> DataFrame:
    """Season of the week, month and year, and month / quarter / option-expiry day flags."""
    t = F.col("datetime")
    weekday, month, doy, day = F.weekday(t), F.month(t), F.dayofyear(t), F.dayofmonth(t)
    last = F.to_date(t) == F.last_day(t)
    turns = {
        "cal_weekday": (weekday, 7.0),
        "cal_month": (month - 1, 12.0),
        "cal_doy": (doy, 365.25),
    }
    out = {"cal_weekday": weekday.cast("double"), "cal_month": month.cast("double")}
    for name, (x, cycle) in turns.items():
        angle = x * (2.0 * math.pi) / cycle
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    out["is_month_start"] = flag_double(day == 1)
    out["is_month_end"] = flag_double(last)
    out["is_quarter_end"] = flag_double(last & (month % 3 == 0))
    out["is_opex_friday"] = flag_double((weekday == 4) & day.between(15, 21))
    return frame.withColumns(out)
