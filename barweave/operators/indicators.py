"""Technical indicators that are window expressions; all share one partitioning and order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from barweave.functions.missing import ratio
from barweave.functions.prefix import Rolling, Series
from barweave.functions.windows import by_symbol, guarded, last_rows, roll, roll_mean, roll_sum, running

# Indicator lengths.
AVERAGE_BARS = (5, 8, 10, 14, 20, 21, 34, 50, 89, 100, 144, 200)
OSCILLATOR_BARS = (7, 14, 21)
HULL_BARS = (21, 55)
SHORT_BARS = 27
KST_STEPS = ((10, 10), (15, 10), (20, 10), (30, 15))
EASE_SCALE = 100_000_000.0

C, H, L, V = "close", "high", "low", "volume"


def _wma(rolling: Rolling, w: WindowSpec, n: int) -> Column:
    """A few values are weighted one by one, which is exact to the last digit; many by their running ramp."""
    return lag_weighted(F.col(C), w, n) if n <= SHORT_BARS else rolling.weighted("x", n)


def add_moving_averages(bars: DataFrame, lengths: tuple[int, ...] = AVERAGE_BARS, hull: tuple[int, ...] = HULL_BARS) -> DataFrame:
    """sma_n, wma_n and hma_n."""
    w = by_symbol()
    inner = {n: (n // 2, int(math.sqrt(n))) for n in hull}
    every = tuple(sorted({*lengths, *hull, *[half for half, _ in inner.values()]}))
    roll = Rolling(bars, w, {"x": Series(F.col(C), squares=False, ramp=True)}, every)
    out = {}
    for n in lengths:
        out[f"sma_{n}"] = roll.mean("x", n, n)
        out[f"wma_{n}"] = _wma(roll, w, n)
    for n, (half, _) in inner.items():
        out[f"_hull_{n}"] = 2.0 * _wma(roll, w, half) - _wma(roll, w, n)
    frame = roll.select(out)
    smooth = {f"hma_{n}": lag_weighted(F.col(f"_hull_{n}"), w, m) for n, (_, m) in inner.items()}
    return frame.withColumns(smooth).drop(*[f"_hull_{n}" for n in hull])


def lag_weighted(x: Column, w: WindowSpec, n: int) -> Column:
    """Linearly weighted mean of a short window by lags; NULL inside gives NULL."""
    total = x * n
    for i in range(1, n):
        total = total + F.lag(x, i).over(w) * (n - i)
    return total / (n * (n + 1) / 2.0)


def typical() -> Column:
    return (F.col(H) + F.col(L) + F.col(C)) / 3.0


def add_oscillators(bars: DataFrame) -> DataFrame:
    """cci_n, roc_n, willr_n and the stochastic pair."""
    w = by_symbol()
    out = {}
    for n in OSCILLATOR_BARS:
        frame = last_rows(w, n)
        values = F.collect_list(typical()).over(frame)
        out[f"_mean_{n}"] = F.avg(typical()).over(frame)
        out[f"_list_{n}"] = values
        out[f"roc_{n}"] = 100.0 * (ratio(F.col(C), F.lag(C, n).over(w)) - 1.0)
        top, bottom = roll(F.max, F.col(H), w, n, n), roll(F.min, F.col(L), w, n, n)
        out[f"willr_{n}"] = -100.0 * ratio(top - F.col(C), top - bottom)
    low, high = roll(F.min, F.col(L), w, 14, 14), roll(F.max, F.col(H), w, 14, 14)
    out["stoch_k_14"] = 100.0 * ratio(F.col(C) - low, high - low)
    frame = bars.withColumns(out)
    cci = {}
    for n in OSCILLATOR_BARS:
        mean = F.col(f"_mean_{n}")
        away = F.aggregate(F.col(f"_list_{n}"), F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / float(n)
        cci[f"cci_{n}"] = F.when(F.size(f"_list_{n}") >= n, ratio(typical() - mean, 0.015 * away))
    cci["stoch_d_14"] = roll_mean(F.col("stoch_k_14"), w, 3, 3)
    return frame.withColumns(cci).drop(*[f"_{k}_{n}" for n in OSCILLATOR_BARS for k in ("mean", "list")])


def add_kst(bars: DataFrame) -> DataFrame:
    """Know-sure-thing: weighted sum of smoothed rates of change, and its 9-bar mean."""
    w = by_symbol()
    changes = {f"_roc_{n}": ratio(F.col(C), F.lag(C, n).over(w)) - 1.0 for n, _ in KST_STEPS}
    frame = bars.withColumns(changes)
    total = None
    for weight, (n, m) in enumerate(KST_STEPS, start=1):
        part = weight * roll_mean(F.col(f"_roc_{n}"), w, m, m)
        total = part if total is None else total + part
    frame = frame.withColumn("kst", 100.0 * total).drop(*changes)
    return frame.withColumn("kst_signal", roll_mean(F.col("kst"), w, 9, 1))


def add_channels(bars: DataFrame) -> DataFrame:
    """Bollinger, Keltner and Donchian channels over 20 bars."""
    w, n = by_symbol(), 20
    frame = last_rows(w, n)
    c, h, l = F.col(C), F.col(H), F.col(L)
    mid = roll_mean(c, w, n, n)
    spread = guarded(F.stddev_pop(c).over(frame), c, frame, n)
    top, bottom = roll(F.max, h, w, n, n), roll(F.min, l, w, n, n)
    first = bars.withColumns(
        {
            "bb_mavg_20_2": mid,
            "_spread": spread,
            "kc_mband_20": roll_mean(typical(), w, n, n),
            "kc_hband_20": roll_mean((4.0 * h - 2.0 * l + c) / 3.0, w, n, n),
            "kc_lband_20": roll_mean((-2.0 * h + 4.0 * l + c) / 3.0, w, n, n),
            "donchian_hband_20": top,
            "donchian_lband_20": bottom,
        }
    )
    m, s, hi, lo = F.col("bb_mavg_20_2"), F.col("_spread"), F.col("donchian_hband_20"), F.col("donchian_lband_20")
    return first.withColumns(
        {
            "bb_hband_20_2": m + 2.0 * s,
            "bb_lband_20_2": m - 2.0 * s,
            "bb_pband_20_2": ratio(c - (m - 2.0 * s), 4.0 * s),
            "bb_wband_20_2": ratio(4.0 * s, m) * 100.0,
            "kc_wband_20": ratio(F.col("kc_hband_20") - F.col("kc_lband_20"), F.col("kc_mband_20")) * 100.0,
            "donchian_mband_20": (hi - lo) / 2.0 + lo,
            "donchian_wband_20": ratio(hi - lo, m) * 100.0,
        }
    ).drop("_spread")


def add_volume_indicators(bars: DataFrame) -> DataFrame:
    """obv, pvt, eom_14, mfi_14, cmf_20."""
    w = by_symbol()
    c, h, l, v, tp = F.col(C), F.col(H), F.col(L), F.col(V), F.col("_tp")
    pc = F.lag(c).over(w)
    place = F.coalesce(ratio((c - l) - (h - c), h - l), F.lit(0.0))
    moved = (h - F.lag(h).over(w)) + (l - F.lag(l).over(w))
    step1 = bars.withColumn("_tp", typical()).withColumns(
        {
            "_signed": F.when(c < pc, -v).otherwise(v),
            "_trend": (ratio(c, pc) - 1.0) * v,
            "_up": F.when(tp > F.lag(tp).over(w), tp * v).otherwise(0.0),
            "_down": F.when(tp < F.lag(tp).over(w), tp * v).otherwise(0.0),
            "_flow": place * v,
            "eom_14": ratio(moved * (h - l), 2.0 * v) * EASE_SCALE,
        }
    )
    up, down = roll_sum(F.col("_up"), w, 14, 14), roll_sum(F.col("_down"), w, 14, 14)
    return step1.withColumns(
        {
            "obv": F.sum("_signed").over(running(w)),
            "pvt": F.sum("_trend").over(running(w)),
            "mfi_14": F.when(down == 0, 100.0).otherwise(100.0 - ratio(F.lit(100.0), 1.0 + ratio(up, down))),
            "cmf_20": ratio(roll_sum(F.col("_flow"), w, 20, 20), roll_sum(v, w, 20, 20)),
        }
    ).drop("_tp", "_signed", "_trend", "_up", "_down", "_flow")


def true_range(w: WindowSpec) -> Column:
    pc = F.lag(C).over(w)
    return F.greatest(F.col(H) - F.col(L), F.abs(F.col(H) - pc), F.abs(F.col(L) - pc))


def add_vortex_ulcer(bars: DataFrame) -> DataFrame:
    """vortex_pos/neg_14 and ulcer_index_14."""
    w, n = by_symbol(), 14
    c = F.col(C)
    step1 = bars.withColumns(
        {
            "_tr": true_range(w),
            "_vp": F.abs(F.col(H) - F.lag(L).over(w)),
            "_vm": F.abs(F.col(L) - F.lag(H).over(w)),
            "_fall": ratio(c - roll(F.max, c, w, n, 1), roll(F.max, c, w, n, 1)) * 100.0,
        }
    )
    fall = F.col("_fall")
    return step1.withColumns(
        {
            "vortex_pos_14": ratio(roll_sum(F.col("_vp"), w, n, n), roll_sum(F.col("_tr"), w, n, n)),
            "vortex_neg_14": ratio(roll_sum(F.col("_vm"), w, n, n), roll_sum(F.col("_tr"), w, n, n)),
            "ulcer_index_14": F.sqrt(roll_mean(fall * fall, w, n, n)),
        }
    ).drop("_tr", "_vp", "_vm", "_fall")


def add_efficiency_entropy(bars: DataFrame) -> DataFrame:
    """efficiency_ratio_10 and entropy_10 (base 2)."""
    w, n = by_symbol(), 10
    c = F.col(C)
    step1 = bars.withColumns(
        {"_step": F.abs(c - F.lag(c).over(w)), "_share": ratio(c, roll_sum(c, w, n, n))}
    )
    share = F.col("_share")
    bits = -share * F.ln(share) / math.log(2.0)
    return step1.withColumns(
        {
            "efficiency_ratio_10": ratio(F.abs(c - F.lag(c, n).over(w)), roll_sum(F.col("_step"), w, n, n)),
            "entropy_10": roll_sum(bits, w, n, n),
        }
    ).drop("_step", "_share")


def add_stoch_rsi(frame: DataFrame) -> DataFrame:
    """Stochastic of rsi_14 (column must be present) with its two 3-bar means."""
    w, r = by_symbol(), F.col("rsi_14")
    low, high = roll(F.min, r, w, 14, 14), roll(F.max, r, w, 14, 14)
    frame = frame.withColumn("stochrsi_14", ratio(r - low, high - low))
    frame = frame.withColumn("stochrsi_k_14", roll_mean(F.col("stochrsi_14"), w, 3, 3))
    return frame.withColumn("stochrsi_d_14", roll_mean(F.col("stochrsi_k_14"), w, 3, 3))


def add_native_indicators(bars: DataFrame) -> DataFrame:
    steps = (
        add_moving_averages, add_oscillators, add_kst, add_channels, add_volume_indicators, add_vortex_ulcer,
        add_efficiency_entropy,
    )
    for step in steps:
        bars = step(bars)
    return bars
