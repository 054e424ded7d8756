"""Relative-strength spreads between components (patterns or models), and market regimes.

Components are few (pattern names or model names), so after the first grouped
aggregate every table is dates x components.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.missing import clip, flag, ratio
from barweave.functions.windows import by_symbol, roll_median, roll_std
from barweave.operators.context import rolling_beta
from barweave.operators.signals import Costs, drop_extreme, period_metrics, periods_per_year

# Regime votes, pair penalties and volatility-target limits.
HIGH_VOL, LOW_VOL, DEEP_DRAWDOWN, VOTE = 1.1, 0.9, -0.08, 0.5
BETA_PENALTY, SIZE_PENALTY, MAX_SCALE = 0.25, 0.15, 3.0


def component_periods(signals: DataFrame, component: str, costs: Costs) -> DataFrame:
    """Per (date, component): mean net return, mean beta, size z-score and distinct symbols."""
    usable = signals.dropna(subset=["datetime", component, "realized_return", "score"])
    usable = drop_extreme(usable).where(F.trim(F.col(component)) != "")
    side = F.when(F.col("score") >= 0, 1).otherwise(-1)
    size = F.log1p(clip(F.col("market_cap"), low=0.0))
    table = usable.groupBy("datetime", F.trim(F.col(component)).alias("component")).agg(
        F.avg(costs.net(side, F.col("realized_return"))).alias("period_return"),
        F.avg("beta_63").alias("component_beta_63"),
        F.avg(size).alias("_size"),
        F.countDistinct("symbol").alias("component_signal_count"),
    )
    w = Window.partitionBy("datetime")
    spread = F.when(F.count("_size").over(w) >= 2, F.nullif(F.stddev_pop("_size").over(w), F.lit(0.0)))
    z = F.when(spread.isNull(), 0.0).otherwise((F.col("_size") - F.avg("_size").over(w)) / spread)
    return table.withColumn("component_size_z", z).drop("_size")


def dense_grid(table: DataFrame) -> DataFrame:
    """Every date with every component; missing combinations are NULL rows.

    The component list is names only, a dozen rows; the date list is the calendar.
    """
    dates = table.select("datetime").distinct()
    names = table.select("component").distinct()
    return dates.crossJoin(names).join(table, ["datetime", "component"], "left")


def spread_table(
    table: DataFrame,
    lookback: int = 63,
    market: DataFrame | None = None,
) -> DataFrame:
    """The grid with trailing score and rolling beta of each component."""
    lb = max(10, lookback)
    grid = dense_grid(table)
    if market is None:
        market = table.groupBy("datetime").agg(F.avg("period_return").alias("market_return"))
    grid = grid.join(market, "datetime", "left")
    w = by_symbol("component")
    n = max(20, lookback)
    past = w.rowsBetween(-lb, -1)
    r = F.col("period_return")
    mean, std, seen = F.avg(r).over(past), F.stddev_samp(r).over(past), F.count(r).over(past)
    trailing = F.coalesce(ratio(mean, std), mean)
    enough = r.isNotNull() & (seen >= max(8, lb // 3)) & (F.row_number().over(w) > lb)
    return grid.withColumns(
        {"beta": rolling_beta(r, F.col("market_return"), w, n, max(5, n // 3)), "score": F.when(enough, trailing)}
    )


def choose_pairs(
    scored: DataFrame, top_k: int = 2, min_edge: float = 0.0, beta_neutral: bool = False, size_neutral: bool = False
) -> DataFrame:
    """One (long, short) pair per date with the best penalised edge."""
    w = Window.partitionBy("datetime")
    ranked = (
        scored.where(F.col("score").isNotNull())
        .withColumns(
            {
                "_top": F.row_number().over(w.orderBy(F.desc("score"), "component")),
                "_n": F.count(F.lit(1)).over(w),
            }
        )
        .where(F.col("_n") >= 2)
    )
    fields = ("component", "score", "period_return", "beta", "component_size_z")

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("datetime", *[F.col(f).alias(f"{name}_{f}") for f in fields])

    longs = side(ranked.where(F.col("_top") <= top_k), "long")
    shorts = side(ranked.where(F.col("_top") > F.col("_n") - top_k), "short")
    pairs = longs.join(shorts, "datetime").where(F.col("long_component") != F.col("short_component"))
    edge = F.col("long_score") - F.col("short_score")
    penalty = F.lit(0.0)
    if beta_neutral:
        penalty = penalty + F.coalesce(BETA_PENALTY * F.abs(F.col("long_beta") - F.col("short_beta")), F.lit(0.0))
    if size_neutral:
        gap = F.abs(F.col("long_component_size_z") - F.col("short_component_size_z"))
        penalty = penalty + F.coalesce(SIZE_PENALTY * gap, F.lit(0.0))
    pairs = pairs.withColumn("edge", edge).where(F.col("edge") >= max(0.0, min_edge)).withColumn("objective", F.col("edge") - penalty)
    best = Window.partitionBy("datetime").orderBy(F.desc("objective"), "long_component", "short_component")
    return pairs.withColumn("_best", F.row_number().over(best)).where(F.col("_best") == 1).drop("_best")


def neutral_weights(pairs: DataFrame, beta_neutral: bool = False, size_neutral: bool = False) -> DataFrame:
    """Weights inverse to beta, half blended with weights inverse to size, summing to one."""

    def inverse(a: str, b: str) -> Column:
        total = F.abs(a) + F.abs(b)
        return F.when(total > 1e-9, F.abs(b) / total)

    long_w = F.lit(0.5)
    if beta_neutral:
        long_w = F.coalesce(inverse("long_beta", "short_beta"), F.lit(0.5))
    if size_neutral:
        by_size = inverse("long_component_size_z", "short_component_size_z")
        long_w = F.coalesce(0.5 * (long_w + by_size), long_w)
    # both sides always add up to one, so no further scaling is needed
    return pairs.withColumn("long_weight", long_w).withColumn("short_weight", 1.0 - F.col("long_weight"))


def spread_returns(weighted: DataFrame, switch_cost_bps: float = 0.0) -> DataFrame:
    """Weighted long minus short return; a changed pair pays the switching cost."""
    w = Window.orderBy("datetime")  # one row per date
    pair = F.struct("long_component", "short_component")
    before = F.lag(pair).over(w)
    changed = flag(before.isNotNull() & (pair != before))
    gross = F.col("long_weight") * F.col("long_period_return") - F.col("short_weight") * F.col("short_period_return")
    return weighted.withColumn("pair_changed", changed).withColumn(
        "period_return", gross - F.col("pair_changed") * (max(0.0, switch_cost_bps) / 10_000.0)
    )


def target_volatility(periods: DataFrame, target: float, lookback: int = 63, interval: str = "1d") -> DataFrame:
    """Scale returns to an annual volatility by the deviation known one period earlier."""
    if target <= 0:
        return periods.withColumn("vol_scale", F.lit(1.0))
    w = Window.orderBy("datetime")  # one row per date
    n = max(10, max(10, lookback) // 2)
    known = periods.withColumn("_std", roll_std(F.col("period_return"), w, n, max(5, n // 3)))
    per_period = target / math.sqrt(periods_per_year(interval))
    scale = F.coalesce(clip(ratio(F.lit(per_period), F.lag("_std").over(w)), 0.0, MAX_SCALE), F.lit(1.0))
    return (
        known.withColumn("vol_scale", scale)
        .withColumn("period_return", F.col("period_return") * F.col("vol_scale"))
        .drop("_std")
    )


def relative_strength(
    signals: DataFrame,
    component: str,
    costs: Costs,
    lookback: int = 63,
    top_k: int = 2,
    min_edge: float = 0.0,
    switch_cost_bps: float = 2.0,
    neutral: bool = False,
    target_vol: float = 0.0,
    market: DataFrame | None = None,
    interval: str = "1d",
) -> DataFrame:
    """Full spread: components, trailing scores, pair, weights, costs, volatility target."""
    scored = spread_table(component_periods(signals, component, costs), lookback, market)
    weighted = neutral_weights(choose_pairs(scored, top_k, min_edge, neutral, neutral), neutral, neutral)
    return target_volatility(spread_returns(weighted, switch_cost_bps), target_vol, lookback, interval)


def regime_states(by_date: DataFrame) -> DataFrame:
    """risk_off / risk_on / neutral per date by counting votes of the columns present."""
    have = set(by_date.columns)
    w = Window.orderBy("datetime")  # one row per date
    if "market_volatility_20" in have:
        vol = F.col("market_volatility_20")
        by_date = by_date.withColumn("_usual", roll_median(vol, w, 252, 20))
    off, on = [], []
    for c in ("macro_regime_high_stress", "regime_high_vol_downtrend", "macro_risk_off_score"):
        if c in have:
            off.append(F.col(c) > VOTE)
    if "market_drawdown_63" in have:
        off.append(F.col("market_drawdown_63") < DEEP_DRAWDOWN)
    if "regime_low_vol_uptrend" in have:
        on.append(F.col("regime_low_vol_uptrend") > VOTE)
    if "market_return_20" in have:
        on.append(F.col("market_return_20") > 0)
    if "market_volatility_20" in have:
        off.append(F.col("market_volatility_20") > HIGH_VOL * F.col("_usual"))
        on.append(F.col("market_volatility_20") < LOW_VOL * F.col("_usual"))

    def votes(conds: list[Column]) -> Column:
        total = F.lit(0)
        for cond in conds:
            total = total + flag(cond)
        return total

    state = F.when(votes(off) >= 2, "risk_off").when(votes(on) >= 2, "risk_on").otherwise("neutral")
    return by_date.select("datetime", state.alias("regime_state"))


def regime_switch(model_spread: DataFrame, pattern_spread: DataFrame, states: DataFrame) -> DataFrame:
    """Pattern spread in risk-off, model spread in risk-on, their mean otherwise; each falls back to the other."""
    m = model_spread.select("datetime", F.col("period_return").alias("_m"))
    p = pattern_spread.select("datetime", F.col("period_return").alias("_p"))
    both = m.join(p, "datetime", "full_outer").join(states, "datetime", "left")
    w = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    state = F.coalesce(F.last("regime_state", ignorenulls=True).over(w), F.lit("neutral"))
    filled = both.withColumn("regime_state", state)
    model, pattern, s = F.col("_m"), F.col("_p"), F.col("regime_state")
    blend = F.coalesce((model + pattern) / 2.0, model, pattern)
    value = F.when(s == "risk_off", F.coalesce(pattern, model)).when(s == "risk_on", F.coalesce(model, pattern)).otherwise(blend)
    choice = (
        F.when(s == "risk_off", F.when(pattern.isNotNull(), "pattern").otherwise("model"))
        .when(s == "risk_on", F.when(model.isNotNull(), "model").otherwise("pattern"))
        .otherwise("blend")
    )
    return filled.select("datetime", "regime_state", choice.alias("regime_choice"), value.alias("period_return")).where(
        F.col("period_return").isNotNull()
    )


def spread_summary(spread: DataFrame, name: str, interval: str = "1d") -> DataFrame:
    """Risk metrics of one spread with its switches and the number of components it used."""
    named = spread.withColumn("strategy", F.lit(name))
    risk = period_metrics(named.select("strategy", "datetime", "period_return"), ["strategy"], interval)
    used = named.select("strategy", "pair_changed", F.explode(F.array("long_component", "short_component")).alias("c"))
    counts = used.groupBy("strategy").agg(
        (F.sum("pair_changed") / 2).cast("bigint").alias("spread_switches"), F.countDistinct("c").alias("spread_components_used")
    )
    return risk.join(counts, "strategy")
