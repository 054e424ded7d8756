"""Search for decision thresholds and picks among result tables.

A grid of long and short thresholds is never applied to the signal rows one
pair at a time.  Rows are first summed per date and probability step; a side's
table for each threshold is a sum over steps; a pair is the sum of two sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.missing import ratio
from barweave.functions.tables import settle
from barweave.operators.signals import Costs, period_metrics

# Grids and weights of the searches.
LONG_GRID = tuple(round(0.53 + 0.01 * i, 2) for i in range(18))
SHORT_GRID = tuple(round(0.30 + 0.01 * i, 2) for i in range(18))
WIDE_LONG_GRID = tuple(round(0.52 + 0.02 * i, 2) for i in range(15))
WIDE_SHORT_GRID = tuple(round(0.18 + 0.02 * i, 2) for i in range(16))
OFFSETS = (-0.08, -0.04, 0.0, 0.04, 0.08)
MIN_GAP = 0.03
DEFAULT_RECOMMENDATION = (0.65, 0.35)


def tie_safe(x: Column) -> Column:
    """Order-preserving value on which pairs that trade the same rows compare equal.

    Neighbouring thresholds often let through identical rows; their sums then
    differ only in the last bits, which must not decide between them.
    """
    return F.round(F.signum(x) * F.log1p(F.abs(x)), 10)


def _side_table(rows: DataFrame, keys: list[str], grid: Sequence[float], long_side: bool, net) -> DataFrame:
    """(keys, threshold, datetime, total, n): net return sum of the rows a threshold lets through."""
    p = F.col("pred_prob_up")
    steps = F.array(*[F.lit(t) for t in grid])
    # how many thresholds of the grid this probability passes
    passed = F.size(F.filter(steps, lambda t: (t <= p) if long_side else (t >= p)))
    summed = (
        rows.withColumn("_passed", passed)
        .where(F.col("_passed") > 0)
        .groupBy(*keys, "datetime", "_passed")
        .agg(F.sum(net).alias("_total"), F.count(F.lit(1)).alias("_n"))
    )
    ordered = sorted(grid) if long_side else sorted(grid, reverse=True)
    ranked = F.array(*[F.lit(t) for t in ordered])
    # a step that passes k thresholds counts for the k easiest ones
    opened = summed.withColumn("threshold", F.explode(F.slice(ranked, F.lit(1), F.col("_passed"))))
    return opened.groupBy(*keys, "threshold", "datetime").agg(F.sum("_total").alias("total"), F.sum("_n").alias("n"))


def pair_periods(
    rows: DataFrame, keys: list[str], longs: Sequence[float], shorts: Sequence[float], costs: Costs, value: str, min_gap: float = 0.0,
    always: tuple[float, float] | None = None,
    keep: tuple[Column, Column] | None = None,
) -> DataFrame:
    """(keys, long_threshold, short_threshold, datetime): trades per side and mean net return.

    The pair ``always`` is evaluated even if its thresholds are closer than ``min_gap``.  ``keep`` tells which rows may be
    bought and which sold (a meta filter looks at a row and its side, never at the threshold that let it through).
    """
    r = F.col(value)
    usable = rows.where(r.isNotNull() & F.col("pred_prob_up").isNotNull())
    buys, sells = keep or (F.lit(True), F.lit(True))
    long_side = _side_table(usable.where(buys), keys, longs, True, costs.net(F.lit(1), r))
    short_side = _side_table(usable.where(sells), keys, shorts, False, costs.net(F.lit(-1), r))

    def others(grid):
        return F.explode(F.array(*[F.lit(t) for t in grid]))

    l = long_side.withColumn("short_threshold", others(shorts)).select(
        *keys, F.col("threshold").alias("long_threshold"), "short_threshold", "datetime", "total",
        F.col("n").alias("n_long"), F.lit(0).cast("bigint").alias("n_short"),
    )
    s = short_side.withColumn("long_threshold", others(longs)).select(
        *keys, "long_threshold", F.col("threshold").alias("short_threshold"), "datetime", "total",
        F.lit(0).cast("bigint").alias("n_long"), F.col("n").alias("n_short"),
    )
    apart = F.col("long_threshold") - F.col("short_threshold")
    wanted = (apart > 0) & (apart >= min_gap - 1e-12)
    if always:
        wanted = wanted | ((F.abs(F.col("long_threshold") - always[0]) < 1e-9) & (F.abs(F.col("short_threshold") - always[1]) < 1e-9) & (apart > 0))
    pairs = l.unionByName(s).where(wanted)
    return (
        pairs.groupBy(*keys, "long_threshold", "short_threshold", "datetime")
        .agg(F.sum("total").alias("_t"), F.sum("n_long").alias("n_long"), F.sum("n_short").alias("n_short"))
        .withColumn("period_return", F.col("_t") / (F.col("n_long") + F.col("n_short")))
        .drop("_t")
    )


def pair_metrics(periods: DataFrame, keys: list[str], interval: str) -> DataFrame:
    """Risk metrics and trade counts per threshold pair."""
    pair = [*keys, "long_threshold", "short_threshold"]
    counts = periods.groupBy(*pair).agg(F.sum("n_long").alias("long_trades"), F.sum("n_short").alias("short_trades"))
    return period_metrics(periods, pair, interval).join(counts, pair)


def optimize_validation(
    rows: DataFrame,
    keys: list[str],
    costs: Costs,
    value: str = "future_excess_return",
    longs: Sequence[float] = LONG_GRID,
    shorts: Sequence[float] = SHORT_GRID,
    min_trades: int | Column = 20,
    min_side: int | Column | None = None,
    exposure_penalty: float = 0.35,
    imbalance_penalty: float = 0.2,
    interval: str = "1d",
) -> DataFrame:
    """Best threshold pair per key by the penalised objective; the default pair when none qualifies.

    Trades pay the transaction cost on either side, but no borrow.  ``min_trades`` and ``min_side`` (together) may be
    columns made of keys.
    """
    costs = replace(costs, borrow_bps_per_day=0.0)
    side = min_side if min_side is not None else max(5, min_trades // 4)
    # the pairs are summed once for their metrics and their counts
    table = pair_metrics(settle(pair_periods(rows, keys, longs, shorts, costs, value)), keys, interval)
    n = F.col("long_trades") + F.col("short_trades")
    lean = F.abs(F.col("long_trades") - F.col("short_trades")) / n
    objective = (
        F.col("cumulative_return")
        + 0.20 * F.col("sharpe")
        + 0.10 * F.col("sortino")
        + 0.10 * F.col("win_rate_period")
        - 0.12 * F.abs("max_drawdown")
        - exposure_penalty * lean
        - imbalance_penalty * lean
        - 0.01 * F.log1p(n)
    )
    good = table.where((n >= min_trades) & (F.col("long_trades") >= side) & (F.col("short_trades") >= side))
    good = good.withColumns({"trades": n, "objective": objective})
    best = good.groupBy(*keys).agg(
        F.max_by(
            F.struct("long_threshold", "short_threshold", "objective", "trades"),
            F.struct(
                tie_safe(F.col("objective")).alias("o"), (-F.col("long_threshold")).alias("l"), (-F.col("short_threshold")).alias("s")
            ),
        ).alias("_b")
    )
    every = rows.select(*keys).distinct()
    return every.join(best, keys, "left").select(
        *keys,
        F.coalesce(F.col("_b.long_threshold"), F.lit(0.55)).alias("long_threshold"),
        F.coalesce(F.col("_b.short_threshold"), F.lit(0.45)).alias("short_threshold"),
        F.coalesce(F.col("_b.objective"), F.lit(0.0)).alias("objective"),
        F.coalesce(F.col("_b.trades"), F.lit(0)).alias("trades"),
    )


def local_grid(base: Sequence[float], current: float, low: float, high: float) -> list[float]:
    """The base grid and offsets around the current threshold, inside [low, high]."""
    return sorted({round(min(max(t, low), high), 10) for t in (*base, *[current + d for d in OFFSETS])})


def optimize_out_of_sample(
    rows: DataFrame,
    keys: list[str],
    costs: Costs,
    current_long: float = 0.55,
    current_short: float = 0.45,
    value: str = "realized_return",
    min_trades: int = 20,
    interval: str = "1d",
    keep: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Best pair by (return, annual return, sharpe, sortino, -drawdown, win rate, trades), with the current pair as baseline."""
    longs = local_grid(WIDE_LONG_GRID, current_long, 0.5, 0.95)
    shorts = local_grid(WIDE_SHORT_GRID, current_short, 0.05, 0.5)
    table = pair_metrics(pair_periods(rows, keys, longs, shorts, costs, value, MIN_GAP, (current_long, current_short), keep), keys, interval)
    n = F.col("long_trades") + F.col("short_trades")
    table = table.withColumn("trades", n).where(n >= min_trades)
    goals = ("cumulative_return", "annualized_return", "sharpe", "sortino")
    order = F.struct(
        *[tie_safe(F.col(c)).alias(c) for c in goals], tie_safe(-F.abs("max_drawdown")).alias("dd"), "win_rate_period", "trades",
        (-F.col("long_threshold")).alias("lt"), (-F.col("short_threshold")).alias("st"),
    )
    now = (F.abs(F.col("long_threshold") - current_long) < 1e-9) & (F.abs(F.col("short_threshold") - current_short) < 1e-9)
    picked = table.groupBy(*keys).agg(
        F.max_by(F.struct("long_threshold", "short_threshold", "trades", "cumulative_return", "sharpe", "max_drawdown"), order).alias("_b"),
        F.max(F.when(now, F.col("cumulative_return"))).alias("_before"),
    )
    return picked.select(*keys, "_b.*", (F.col("_b.cumulative_return") - F.col("_before")).alias("improvement_cumulative_return"))


def recommend(models: DataFrame) -> DataFrame:
    """One row: thresholds averaged over models, weighted by their edge and training size."""
    inside = F.col("tuned_long_threshold").between(0, 1) & F.col("tuned_short_threshold").between(0, 1)
    edge = F.greatest(F.coalesce("roc_auc", F.lit(0.5)) - 0.5, F.lit(0.01))
    rows = F.greatest(F.coalesce(F.col("train_rows").cast("double"), F.lit(0.0)), F.lit(1.0))
    weighted = models.where(inside).withColumn("_w", edge * F.log1p(rows))

    def mean(c):
        return ratio(F.sum(F.col(c) * F.col("_w")), F.sum("_w"))

    means = weighted.agg(
        mean("tuned_long_threshold").alias("_l"), mean("tuned_short_threshold").alias("_s"), F.count(F.lit(1)).alias("models_considered")
    )
    long_default, short_default = DEFAULT_RECOMMENDATION
    long_at = F.least(F.greatest(F.col("_l"), F.lit(0.60)), F.lit(0.95))
    short_at = F.least(F.greatest(F.col("_s"), F.lit(0.05)), F.lit(0.40))
    # the clipped ranges cannot cross: long is at least .60, short at most .40
    return means.select(
        F.when(F.col("_l").isNotNull(), long_at).otherwise(long_default).alias("recommended_long_threshold"),
        F.when(F.col("_s").isNotNull(), short_at).otherwise(short_default).alias("recommended_short_threshold"),
        "models_considered",
    )


def pick_objective_row(results: DataFrame, min_trades: int = 0) -> DataFrame:
    """The best row, portfolio rows first when there are any."""
    is_portfolio = F.col("model_file").startswith("portfolio_") | F.col("pattern").startswith("portfolio_")
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    score = (
        F.coalesce("cumulative_return", F.lit(-1e9))
        + 0.30 * filled("sharpe")
        + 0.20 * filled("win_rate_trade")
        - 0.20 * F.abs(filled("max_drawdown"))
        - 0.0002 * filled("trades")
    )
    has_portfolio = F.max(is_portfolio.cast("int")).over(Window.partitionBy(F.lit(0)))  # result table: one row per model
    candidates = results.withColumn("_p", has_portfolio).where(is_portfolio.cast("int") == F.col("_p"))
    if min_trades > 0:
        candidates = candidates.where(F.col("trades") >= min_trades)
    scored = candidates.drop("_p").withColumn("objective_score", score)
    return scored.orderBy(F.desc("objective_score"), F.desc("cumulative_return"), "pattern", "model_file").limit(1)


def top_patterns(results: DataFrame, top_n: int = 8, min_trades: int = 0) -> DataFrame:
    """Best single patterns (no portfolio or spread rows) by rank score."""
    single = ~(F.col("pattern").startswith("portfolio_") | F.col("pattern").startswith("spread_")) & (F.col("pattern") != "")
    score = (
        F.coalesce("cumulative_return", F.lit(-1e9))
        + 0.20 * F.coalesce("sharpe", F.lit(0.0))
        - 0.0001 * F.coalesce(F.col("trades").cast("double"), F.lit(0.0))
    )
    rows = results.where(single)
    if min_trades > 0:
        rows = rows.where(F.col("trades") >= min_trades)
    return rows.withColumn("rank_score", score).orderBy(F.desc("rank_score"), "pattern").limit(max(1, top_n))
