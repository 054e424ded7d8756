"""From a signal table to weighted portfolios: floor, thinning, selection, sizing, summary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barweave.functions.missing import clip, ratio
from barweave.functions.tables import settle
from barweave.operators.signals import Costs, period_metrics, trade_metrics

# Fixed values of the sizing rule.
VOL_FLOOR, VOL_CEILING, QUALITY_FLOOR = 0.005, 2.0, 1e-6


def score_floor(signals: DataFrame, min_abs_score: float) -> DataFrame:
    complete = signals.dropna(subset=["datetime", "symbol", "score", "realized_return"])
    return complete.where(F.abs("score") >= min_abs_score) if min_abs_score > 0 else complete


def signal_calendar(signals: DataFrame) -> DataFrame:
    """Signal dates with their 0-based position; distinct dates only, so the ordered step is calendar-sized."""
    dates = signals.select("datetime").distinct()
    return dates.withColumn("bar_index", F.row_number().over(Window.orderBy("datetime")) - 1)


def thin_rebalances(signals: DataFrame, every: int) -> DataFrame:
    """Keep every n-th signal date."""
    if every <= 1:
        return signals
    kept = signal_calendar(signals).where(F.col("bar_index") % every == 0).select("datetime")
    return signals.join(settle(kept), "datetime", "left_semi")


def collapse(signals: DataFrame) -> DataFrame:
    """One row per (date, symbol): mean score, return and volatility of all its signals."""
    return signals.groupBy("datetime", "symbol").agg(
        *[F.avg(c).alias(c) for c in ("score", "realized_return", "volatility_20")]
    )


def spaced_signals(signals: DataFrame, gap: int) -> DataFrame:
    """Per symbol, drop a signal that comes within ``gap`` signal dates of the last kept one.

    Greedy by nature, so it walks each symbol's positions in order; a symbol
    has at most one row per signal date.
    """
    if gap <= 0:
        return signals
    placed = signals.join(settle(signal_calendar(signals)), "datetime")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_index")
        keep, last = [], None
        for at in pdf["bar_index"].to_numpy():
            ok = last is None or at - last > gap
            keep.append(ok)
            last = at if ok else last
        return pdf[keep]

    keys = placed.select("symbol", "datetime", "bar_index").distinct()
    kept = keys.groupBy("symbol").applyInPandas(walk, keys.schema).select("symbol", "datetime")
    return signals.join(kept, ["symbol", "datetime"], "left_semi")


def pick_sides(collapsed: DataFrame, k: int) -> DataFrame:
    """Best ``k`` positive and worst ``k`` negative scores per date (column ``side``)."""
    sided = collapsed.where(F.col("score") != 0).withColumn("side", F.signum("score").cast("int"))
    w = Window.partitionBy("datetime", "side").orderBy(F.desc(F.abs("score")), "symbol")
    return sided.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def size_positions(
    picked: DataFrame, max_gross: float = 1.0, max_symbol_weight: float = 0.35, volatility_scaling: bool = True
) -> DataFrame:
    """Quality over volatility weights per side, capped per symbol, inside the side budget and gross limit."""
    cap = min(max(0.01, max_symbol_weight), max(0.01, max_gross))
    vol = F.nullif(F.abs("volatility_20"), F.lit(0.0))
    quality = F.greatest(F.abs("score"), F.lit(QUALITY_FLOOR))
    raw = F.coalesce(quality / clip(vol, VOL_FLOOR, VOL_CEILING), F.lit(0.0)) if volatility_scaling else F.lit(1.0)
    by_side, by_date = Window.partitionBy("datetime", "side"), Window.partitionBy("datetime")
    both = F.min("side").over(by_date) != F.max("side").over(by_date)
    sized = picked.withColumns({"_raw": raw, "_budget": F.when(both, max_gross * 0.5).otherwise(max_gross)})
    share = F.when(F.sum("_raw").over(by_side) > 0, ratio(F.col("_raw"), F.sum("_raw").over(by_side))).otherwise(
        1.0 / F.count(F.lit(1)).over(by_side)
    )
    sized = sized.withColumn("_w", F.least(F.col("_budget") * share, F.lit(cap)))
    spent = F.sum("_w").over(by_side)
    sized = sized.withColumn(
        "_w", F.when(spent > F.col("_budget"), F.col("_budget") * ratio(F.col("_w"), spent)).otherwise(F.col("_w"))
    )
    gross = F.sum("_w").over(by_date)
    sized = sized.withColumn("_w", F.when(gross > max_gross, F.col("_w") * ratio(F.lit(max_gross), gross)).otherwise(F.col("_w")))
    weighted = sized.where(F.col("_budget") > 0).withColumn("weight", F.col("side") * F.col("_w"))
    return weighted.drop("_raw", "_budget", "_w")


def trade_returns(weighted: DataFrame, costs: Costs) -> DataFrame:
    w = F.col("weight")
    borrow = F.when(w < 0, F.abs(w) * costs.short_extra).otherwise(0.0)
    net = w * F.col("realized_return") - F.abs(w) * costs.per_trade - borrow
    return weighted.withColumn("trade_return", net)


def portfolio_trades(
    signals: DataFrame,
    costs: Costs,
    top_k: int = 5,
    max_gross: float = 1.0,
    max_symbol_weight: float = 0.35,
    min_abs_score: float = 0.0,
    rebalance_every: int = 1,
    min_gap: int = 0,
    volatility_scaling: bool = True,
) -> DataFrame:
    chosen = thin_rebalances(score_floor(signals, min_abs_score), rebalance_every)
    picked = pick_sides(collapse(spaced_signals(chosen, min_gap)), top_k)
    return trade_returns(size_positions(picked, max_gross, max_symbol_weight, volatility_scaling), costs)


def portfolio_periods(trades: DataFrame) -> DataFrame:
    return trades.groupBy("datetime").agg(F.sum("trade_return").alias("period_return"))


def portfolio_summary(trades: DataFrame, interval: str = "1d", name: str = "portfolio_combined") -> DataFrame:
    named = trades.withColumn("pattern", F.lit(name)).withColumnRenamed("trade_return", "strategy_return")
    periods = named.groupBy("pattern", "datetime").agg(F.sum("strategy_return").alias("period_return"))
    risk = period_metrics(periods, ["pattern"], interval).drop("profit_factor_period", "periods")
    return trade_metrics(named, ["pattern"]).join(risk, "pattern")


def best_patterns(rows: DataFrame, top_n: int = 6, min_trades: int = 40, min_win_rate: float = 0.5) -> DataFrame:
    """Best model variant per pattern, then the best patterns by objective score."""
    filled = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    trades = filled("trades", 0).cast("double")
    objective = (
        filled("cumulative_return", -1e9)
        + 0.20 * filled("sharpe", 0.0)
        - 0.15 * F.abs(filled("max_drawdown", 0.0))
        + 0.20 * filled("win_rate_trade", 0.0)
        - 0.01 * F.log1p(F.greatest(trades, F.lit(0.0)))
    )
    usable = rows.where(~F.col("pattern").startswith("portfolio_"))
    if min_trades > 0:
        usable = usable.where(trades >= min_trades)
    if min_win_rate > 0:
        usable = usable.where(F.col("win_rate_trade") >= min_win_rate)
    scored = usable.withColumn("objective_score", objective)
    order = F.struct("objective_score", "cumulative_return", "model_file")
    best = scored.groupBy("pattern").agg(F.max_by(F.struct(*scored.columns), order).alias("_r")).select("_r.*")
    return best.orderBy(F.desc("objective_score"), F.desc("cumulative_return"), "pattern").limit(max(1, top_n))
