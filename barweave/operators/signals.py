"""Positions, trading costs, period returns, risk metrics and equity curves.

All reports work on one long signal or period table with a key per strategy:
one grouped aggregation serves every strategy at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.missing import ratio
from barweave.functions.tables import keep_first
from barweave.functions.windows import by_symbol, running
from barweave.operators.labels import BARS_PER_DAY, embargoed, label_price
from barweave.operators.patterns import blind_side

# Fixed values of the reports.
RETURN_FLOOR = -0.999999999
MAX_ABS_RETURN = 3.0
DEFAULT_LONG, DEFAULT_SHORT = 0.55, 0.45
TRADING_DAYS = 252.0
YEAR_SECONDS = 365.25 * 24 * 3600


def periods_per_year(interval: str) -> float:
    return TRADING_DAYS * BARS_PER_DAY.get(interval, 1.0)


@dataclass(frozen=True)
class Costs:
    """Trading frictions in basis points, for one interval and holding length."""

    fee_bps: float = 1.0
    spread_bps: float = 2.0
    slippage_bps: float = 1.0
    borrow_bps_per_day: float = 0.5
    interval: str = "1d"
    horizon: int = 1
    latency: int = 0

    @property
    def per_trade(self) -> float:
        return (self.fee_bps + self.spread_bps + 2.0 * self.slippage_bps) / 10_000.0

    @property
    def holding_days(self) -> float:
        return max(1, self.horizon + max(0, self.latency)) / BARS_PER_DAY.get(self.interval, 1.0)

    @property
    def short_extra(self) -> float:
        return self.borrow_bps_per_day / 10_000.0 * self.holding_days

    def net(self, position: Column, gross: Column) -> Column:
        borrow = F.when(position < 0, F.lit(self.short_extra)).otherwise(0.0)
        return position * gross - F.lit(self.per_trade) - borrow


def add_realized_return(frame: DataFrame, horizon: int = 1, latency: int = 0) -> DataFrame:
    if not {"adj_close", "close"} & set(frame.columns):
        known = F.col("future_return") if latency == 0 and "future_return" in frame.columns else F.lit(None).cast("double")
        return frame.withColumn("realized_return", known)
    price, w = label_price(frame), by_symbol()
    lag = max(0, latency)
    entry = F.lead(price, lag).over(w) if lag else price
    exit_ = F.lead(price, lag + max(1, horizon)).over(w)
    return frame.withColumn("realized_return", F.try_divide(exit_, entry) - 1.0)


def drop_extreme(frame: DataFrame, limit: float = MAX_ABS_RETURN) -> DataFrame:
    return frame if limit <= 0 else frame.where(F.abs("realized_return") <= limit)


def position(prob: Column, long_at: Column, short_at: Column) -> Column:
    """1 / -1 / 0; where both thresholds match the short side wins."""
    return F.when(prob <= short_at, -1).when(prob >= long_at, 1).otherwise(0)


def resolve_threshold(explicit: Column, tuned: Column, default: float) -> Column:
    return F.coalesce(explicit, tuned, F.lit(default))


def period_returns(trades: DataFrame, keys: list[str], value: str = "strategy_return") -> DataFrame:
    """Mean of concurrent trades per (keys, datetime)."""
    return (
        trades.where(F.col(value).isNotNull() & F.col("datetime").isNotNull())
        .groupBy(*keys, "datetime")
        .agg(F.avg(value).alias("period_return"))
    )


def log_growth(r: Column) -> Column:
    return F.log1p(F.greatest(r, F.lit(RETURN_FLOOR)))


def sharpe(r: Column, ppy: float) -> Column:
    return F.coalesce(ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(ppy)), F.lit(0.0))


def sortino(r: Column, ppy: float) -> Column:
    downside = F.stddev_samp(F.when(r < 0, r))
    return F.coalesce(F.when(downside > 0, F.avg(r) / downside) * F.sqrt(F.lit(ppy)), F.lit(0.0))


def profit_factor(r: Column) -> Column:
    loss = -F.sum(F.when(r < 0, r).otherwise(0.0))
    return F.when(loss > 1e-12, F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), loss))


def share_positive(r: Column) -> Column:
    return F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0))


def drawdowns(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Drawdown of every period against the running peak of growth.

    The peak starts at the first period, not at the initial capital.
    """
    w = running(Window.partitionBy(*keys).orderBy("datetime"))
    grown = periods.withColumn("_g", F.exp(F.sum(log_growth(F.col("period_return"))).over(w)))
    return grown.withColumn("drawdown", F.col("_g") / F.max("_g").over(w) - 1.0).drop("_g")


def period_metrics(periods: DataFrame, keys: list[str], interval: str = "1d") -> DataFrame:
    """Risk metrics per key from one row per period."""
    ppy = periods_per_year(interval)
    r = F.col("period_return")
    elapsed = (F.unix_seconds(F.max("datetime")) - F.unix_seconds(F.min("datetime"))) / F.lit(YEAR_SECONDS)
    years = F.when(F.count(r) >= 2, elapsed + 1.0 / ppy).otherwise(1.0 / ppy)
    total = F.sum(log_growth(r))
    per_year = F.greatest(F.lit(1e-9), F.count(r) / years)
    return (
        drawdowns(periods.where(r.isNotNull()), keys)
        .groupBy(*keys)
        .agg(
            F.count(r).alias("periods"),
            F.expm1(total).alias("cumulative_return"),
            sharpe(r, ppy).alias("sharpe"),
            sortino(r, ppy).alias("sortino"),
            F.min("drawdown").alias("max_drawdown"),
            share_positive(r).alias("win_rate_period"),
            profit_factor(r).alias("profit_factor_period"),
            (F.exp(total / years) - 1.0).alias("annualized_return"),
            F.coalesce(F.stddev_samp(r) * F.sqrt(per_year), F.lit(0.0)).alias("annualized_volatility"),
            F.min("datetime").alias("start_datetime"),
            F.max("datetime").alias("end_datetime"),
        )
    )


def trade_metrics(trades: DataFrame, keys: list[str], value: str = "strategy_return") -> DataFrame:
    r = F.col(value)
    return trades.groupBy(*keys).agg(
        F.count(r).alias("trades"),
        share_positive(r).alias("win_rate_trade"),
        F.avg(r).alias("avg_trade_return"),
        profit_factor(r).alias("profit_factor"),
    )


def summary(trades: DataFrame, keys: list[str], interval: str = "1d") -> DataFrame:
    """Full report row per key from a trade table with ``strategy_return``."""
    by_period = period_metrics(period_returns(trades, keys), keys, interval).drop("profit_factor_period", "periods")
    return trade_metrics(trades, keys).join(by_period, keys)


def equity_curve(periods: DataFrame, keys: list[str], initial: float = 10_000.0) -> DataFrame:
    w = running(Window.partitionBy(*keys).orderBy("datetime"))
    r = F.greatest(F.col("period_return"), F.lit(RETURN_FLOOR))
    growth = F.exp(F.sum(F.log1p(r)).over(w))
    return (
        periods.where(F.col("period_return").isNotNull())
        .select(*keys, "datetime", r.alias("period_return"), growth.alias("_g"))
        .select(
            *keys,
            "datetime",
            "period_return",
            (F.col("_g") - 1.0).alias("cumulative_return"),
            (F.col("_g") * initial).alias("equity_value"),
            F.lit(float(initial)).alias("initial_investment"),
        )
    )


def curve_pivot(curves: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Dates by curve label -> last equity value."""
    return curves.groupBy("datetime").pivot(label, labels).agg(F.max_by("equity_value", F.struct("period_return", "equity_value")))


def blind_trades(hits: DataFrame, costs: Costs, pattern: str = "member") -> DataFrame:
    """Trade every pattern hit on the side its name implies."""
    usable = drop_extreme(hits.where(F.col("realized_return").isNotNull()))
    side = blind_side(F.col(pattern))
    return usable.withColumn("position", side).withColumn(
        "strategy_return", costs.net(F.col("position"), F.col("realized_return"))
    )


def universe_baseline(frame: DataFrame) -> DataFrame:
    """Equal-weight mean realized return per date."""
    return (
        drop_extreme(frame.where(F.col("realized_return").isNotNull()))
        .groupBy("datetime")
        .agg(F.avg("realized_return").alias("period_return"))
    )


def dedupe_windows(signals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, symbol, datetime): earliest window, then the most decided probability."""
    order = [F.col("window_start"), -F.abs(F.col("pred_prob_up") - 0.5), F.col("pred_prob_up")]
    return keep_first(signals, [*keys, "symbol", "datetime"], order)


def first_judged(models: DataFrame, frame: DataFrame, interval: str, embargo_bars: int = 0) -> DataFrame:
    """``judged_from`` of each model: the later of its training end and test start, plus the embargo.

    A model without a training end takes the last training date of the dataset.  NULL, where no date is known or no
    row of the dataset is that late, stands for the rows marked test.
    """
    last = frame.agg(F.max(F.when(F.col("split") == "train", F.col("datetime"))).alias("_train"), F.max("datetime").alias("_last"))
    dated = models.crossJoin(F.broadcast(last))  # one row
    start = embargoed(F.greatest(F.coalesce("train_end", "_train"), F.col("test_start")), interval, embargo_bars)
    return dated.withColumn("judged_from", F.when(start <= F.col("_last"), start)).drop("_train", "_last")


def is_judged() -> Column:
    return F.coalesce(F.col("datetime") >= F.col("judged_from"), F.col("split") == "test")


def out_of_sample(hits: DataFrame, models: DataFrame, interval: str, embargo_bars: int = 0, frame: DataFrame | None = None) -> DataFrame:
    """Pattern rows each model may be judged on, joined by pattern.

    ``hits`` has the pattern of a row in ``member``; ``models`` has one row per model: model_file, pattern, train_end,
    test_start.  ``frame`` is the dataset whose dates bound the fall-backs, if not ``hits`` itself.
    """
    dated = first_judged(models, hits if frame is None else frame, interval, embargo_bars)
    return hits.join(dated, F.col("member") == F.col("pattern")).where(is_judged())


def combine_curves(periods: DataFrame, chosen: list[str], label: str = "pattern", initial: float = 10_000.0) -> DataFrame:
    """Average the chosen strategies per date, then compound again."""
    mixed = (
        periods.where(F.col(label).isin(chosen))
        .groupBy("datetime")
        .agg(F.avg("period_return").alias("period_return"))
        .withColumn("combined", F.lit("combined"))
    )
    return equity_curve(mixed, ["combined"], initial)
