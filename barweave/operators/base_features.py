"""Per-symbol price and volume features over native windows (one exchange, one sort)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barweave.functions.missing import ratio
from barweave.functions.prefix import Rolling, Series
from barweave.functions.windows import (
    by_symbol,
    island_number,
    pct_change,
    roll_mean,
    run_length,
)

# Look-back lengths.
RETURN_BARS = (1, 2, 3, 5, 10)
ROLL_BARS = (5, 10, 20, 50, 100, 200)


def add_returns(bars: DataFrame) -> DataFrame:
    """ret_n, log_ret_1."""
    w = by_symbol()
    c = F.col("close")
    out = {f"ret_{n}": pct_change(c, w, n) for n in RETURN_BARS}
    out["log_ret_1"] = F.ln(ratio(c, F.lag(c).over(w)))
    return bars.withColumns(out)


def add_shape(bars: DataFrame) -> DataFrame:
    """Bar-shape ratios, opening gap and traded value."""
    w = by_symbol()
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    pc = F.lag(c).over(w)
    value = c * F.nullif(v, F.lit(0.0))
    return bars.withColumns(
        {
            "hl_spread": ratio(h - l, c),
            "co_spread": ratio(c - o, o),
            "gap": ratio(o - pc, pc),
            "dollar_volume": value,
            "log_dollar_volume": F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0)))),
        }
    )


def add_rolling(frame: DataFrame, lengths: tuple[int, ...] = ROLL_BARS) -> DataFrame:
    """Volatility, close / volume z-scores and mean traded value; needs ret_1 and dollar_volume."""
    series = {
        "ret": Series(F.col("ret_1")),
        "close": Series(F.col("close")),
        "volume": Series(F.nullif(F.col("volume"), F.lit(0.0))),
        "value": Series(F.col("dollar_volume"), squares=False),
    }
    roll = Rolling(frame, by_symbol(), series, lengths)
    out = {}
    for n in lengths:
        half, third = max(5, n // 2), max(5, n // 3)
        out[f"volatility_{n}"] = roll.std("ret", n, half)
        out[f"z_close_{n}"] = roll.z("close", n, third)
        out[f"z_volume_{n}"] = roll.z("volume", n, third)
        out[f"dollar_volume_mean_{n}"] = roll.mean("value", n, third)
    return roll.select(out)


def add_range_liquidity(frame: DataFrame) -> DataFrame:
    """Range against its 20-bar mean, and price impact per traded value."""
    w = by_symbol()
    spread = F.col("high") - F.col("low")
    impact = ratio(F.abs("ret_1"), F.col("dollar_volume"))
    return frame.withColumns(
        {
            "range_to_atr20_proxy": ratio(spread, roll_mean(spread, w, 20, 5)),
            "amihud_illiquidity_20": roll_mean(impact, w, 20, 5),
        }
    )


def add_streaks(frame: DataFrame) -> DataFrame:
    """Lengths of the current run of rising / falling bars."""
    w = by_symbol()
    r = F.col("ret_1")
    numbered = frame.withColumns({"_up_run": island_number(r <= 0, w), "_down_run": island_number(r >= 0, w)})
    return numbered.withColumns(
        {
            "up_streak": run_length(r > 0, r <= 0, "_up_run", ["symbol"]),
            "down_streak": run_length(r < 0, r >= 0, "_down_run", ["symbol"]),
        }
    ).drop("_up_run", "_down_run")


def add_base_features(bars: DataFrame) -> DataFrame:
    return add_streaks(add_range_liquidity(add_rolling(add_shape(add_returns(bars)))))


def add_distances(frame: DataFrame) -> DataFrame:
    """dist_<ma> for every moving-average column present."""
    averages = [c for c in frame.columns if c.startswith(("sma_", "ema_", "wma_", "hma_"))]
    return frame.withColumns({f"dist_{a}": ratio(F.col("close") - F.col(a), F.col(a)) for a in averages})


def add_volume_deltas(frame: DataFrame) -> DataFrame:
    """One-bar relative change of volume and obv columns."""
    w = by_symbol()
    names = [c for c in frame.columns if c.startswith(("volume", "obv"))]
    return frame.withColumns({f"delta_{c}": pct_change(F.col(c), w) for c in names})
