"""SQL twins of the shared model tables, as named CTE texts for the oracle side."""

from __future__ import annotations

WEEKLY = """
bars AS (
  SELECT symbol, datetime,
         first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS open,
         max(price) AS high, min(price) AS low,
         last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS close,
         sum(l_quantity) AS volume
  FROM (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS datetime,
               l_extendedprice / l_quantity AS price, * FROM lineitem)
  GROUP BY symbol, datetime)"""

EVENT_DAY = """
day_bars AS (
  SELECT user_id AS symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS datetime,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""

RETURNS = """
rets AS (
  SELECT *, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 2) OVER w - 1 AS ret_2,
         close / lag(close, 3) OVER w - 1 AS ret_3, close / lag(close, 5) OVER w - 1 AS ret_5,
         close / lag(close, 10) OVER w - 1 AS ret_10, ln(close / lag(close) OVER w) AS log_ret_1
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY datetime))"""

PATTERN_NAMES = [
    "bullish_engulfing", "bearish_engulfing", "hammer", "shooting_star", "doji", "morning_star",
    "evening_star", "bullish_harami", "bearish_harami", "piercing_line", "dark_cloud_cover",
]

LAGS = """
lags AS (
  SELECT *, abs(close - open) AS body, greatest(open, close) AS top, least(open, close) AS bottom,
         CASE WHEN high > low THEN abs(close - open) / (high - low) END AS share,
         lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc,
         lag(open, 2) OVER w AS p2o, lag(close, 2) OVER w AS p2c
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
lags2 AS (
  SELECT *, abs(pc - po) AS pbody, abs(p2c - p2o) AS p2body,
         quantile_cont(abs(p2c - p2o), 0.5) OVER (PARTITION BY symbol ORDER BY datetime ROWS 19 PRECEDING) AS p2median
  FROM lags)"""

RULES = {
    "bullish_engulfing": "close > open AND pc < po AND open <= pc AND close >= po AND body > pbody",
    "bearish_engulfing": "close < open AND pc > po AND open >= pc AND close <= po AND body > pbody",
    "hammer": "bottom - low > 2.2 * body AND high - top < 0.6 * body + 1e-9 AND share < 0.45",
    "shooting_star": "high - top > 2.2 * body AND bottom - low < 0.6 * body + 1e-9 AND share < 0.45",
    "doji": "share <= 0.1",
    "morning_star": "p2c < p2o AND p2body > p2median AND pbody < p2body * 0.6 AND close > open AND close > (p2o + p2c) / 2",
    "evening_star": "p2c > p2o AND p2body > p2median AND pbody < p2body * 0.6 AND close < open AND close < (p2o + p2c) / 2",
    "bullish_harami": "pc < po AND close > open AND open > pc AND close < po AND body < pbody",
    "bearish_harami": "pc > po AND close < open AND open < pc AND close > po AND body < pbody",
    "piercing_line": "pc < po AND close > open AND open < pl AND close > (po + pc) / 2 AND close < po",
    "dark_cloud_cover": "pc > po AND close < open AND open > ph AND close < (po + pc) / 2 AND close > po",
}

FLAGS = (
    LAGS
    + """,
flagged AS (
  SELECT symbol, datetime, open, high, low, close, volume,
"""
    + ",\n".join(f"         CASE WHEN {RULES[p]} THEN 1 ELSE 0 END AS pattern_{p}" for p in PATTERN_NAMES)
    + "\n  FROM lags2),\nlabeled AS (\n  SELECT *, CASE "
    + " ".join(f"WHEN pattern_{p} = 1 THEN '{p}'" for p in PATTERN_NAMES)
    + " END AS pattern FROM flagged)"
)

MEMBERS = """
members AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT *, '{p}' AS member FROM labeled WHERE pattern_{p} = 1" for p in PATTERN_NAMES
) + "\n  UNION ALL\n  SELECT *, 'none' AS member FROM labeled WHERE pattern IS NULL)"

REALIZED = """
realized AS (
  SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY datetime) / close - 1 AS realized_return
  FROM {source})"""

# blind trades of every pattern member, default costs: 5 bps per trade, 0.5 bps borrow on shorts
BLIND = """
blind AS (
  SELECT *, side * realized_return - 5.0 / 10000 - CASE WHEN side < 0 THEN 0.5 / 10000 ELSE 0 END AS strategy_return
  FROM (SELECT m.*, r.realized_return,
               CASE WHEN regexp_matches(member, 'bearish|shooting_star|evening_star|dark_cloud_cover') THEN -1 ELSE 1 END AS side
        FROM members m JOIN realized r USING (symbol, datetime))
  WHERE abs(realized_return) <= 3)"""

FUTURE = """
fut AS (
  SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY datetime) / close - 1 AS future_return FROM bars),
labels AS (
  SELECT *, future_return - future_market_return AS future_excess_return,
         CASE WHEN future_return IS NOT NULL THEN
           (rank() OVER (PARTITION BY datetime ORDER BY future_return)
            + (count(*) OVER (PARTITION BY datetime, future_return) - 1) / 2.0)
           / count(future_return) OVER (PARTITION BY datetime) END AS future_rank_pct
  FROM (SELECT *, avg(future_return) OVER (PARTITION BY datetime) AS future_market_return FROM fut))"""


def metrics_sql(source: str, keys: str, ppy: float = 252.0) -> str:
    """CTEs ``{source}_metrics`` from a period table (keys, datetime, period_return)."""
    return f"""
{source}_growth AS (
  SELECT *, exp(sum(ln(1 + greatest(period_return, -0.999999999))) OVER (PARTITION BY {keys} ORDER BY datetime
                ROWS UNBOUNDED PRECEDING)) AS growth FROM {source}),
{source}_dd AS (
  SELECT *, growth / max(growth) OVER (PARTITION BY {keys} ORDER BY datetime ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
  FROM {source}_growth),
{source}_base AS (
  SELECT {keys}, count(*) AS periods, sum(ln(1 + greatest(period_return, -0.999999999))) AS total,
         avg(period_return) AS mean_r, stddev_samp(period_return) AS std_r,
         stddev_samp(period_return) FILTER (WHERE period_return < 0) AS down_r,
         min(drawdown) AS max_drawdown,
         avg(CASE WHEN period_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate_period,
         min(datetime) AS start_datetime, max(datetime) AS end_datetime,
         CASE WHEN count(*) >= 2 THEN (epoch(max(datetime)) - epoch(min(datetime))) / (365.25 * 86400) + 1.0 / {ppy}
              ELSE 1.0 / {ppy} END AS years
  FROM {source}_dd GROUP BY {keys}),
{source}_metrics AS (
  SELECT {keys}, periods, exp(total) - 1 AS cumulative_return,
         CASE WHEN std_r > 0 THEN mean_r / std_r * sqrt({ppy}) ELSE 0 END AS sharpe,
         CASE WHEN down_r > 0 THEN mean_r / down_r * sqrt({ppy}) ELSE 0 END AS sortino,
         max_drawdown, win_rate_period, exp(total / years) - 1 AS annualized_return,
         coalesce(std_r * sqrt(greatest(1e-9, periods / years)), 0) AS annualized_volatility,
         start_datetime, end_datetime
  FROM {source}_base)"""


TRADE_METRICS = """
  count(*) AS trades, avg(CASE WHEN strategy_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate_trade,
  avg(strategy_return) AS avg_trade_return,
  CASE WHEN -sum(CASE WHEN strategy_return < 0 THEN strategy_return ELSE 0 END) > 1e-12
       THEN sum(CASE WHEN strategy_return > 0 THEN strategy_return ELSE 0 END)
            / -sum(CASE WHEN strategy_return < 0 THEN strategy_return ELSE 0 END) END AS profit_factor
"""


def recursive(name: str, source: str, columns: dict[str, tuple[str, str]]) -> str:
    """Walk ``source`` (with row number i per symbol) bar by bar; each column is (first value, step over r and s)."""
    first = ", ".join(f"CAST({a} AS DOUBLE) AS {c}" for c, (a, _) in columns.items())
    step = ", ".join(f"CAST({b} AS DOUBLE) AS {c}" for c, (_, b) in columns.items())
    names = ", ".join(columns)
    return f"""
{name}_walk AS (
  SELECT symbol, i, {first} FROM {source} s WHERE i = 1
  UNION ALL
  SELECT s.symbol, s.i, {step} FROM {name}_walk r JOIN {source} s ON s.symbol = r.symbol AND s.i = r.i + 1),
{name} AS (SELECT s.*, {", ".join("w." + c for c in columns)} FROM {source} s JOIN {name}_walk w ON s.symbol = w.symbol AND s.i = w.i)"""


def ewm(x: str, out: str, alpha: float) -> tuple[str, str]:
    """Exponential mean that starts at the first non-null value (no gaps later)."""
    return f"s.{x}", f"CASE WHEN r.{out} IS NULL THEN s.{x} ELSE r.{out} + {alpha!r} * (s.{x} - r.{out}) END"


def wilder(x: str, out: str, n: int) -> tuple[str, str]:
    """Wilder mean; the source has {x}_n (running count) and {x}_m (mean of the last n)."""
    return (
        f"CASE WHEN {n} = 1 THEN s.{x} END",
        f"CASE WHEN s.{x}_n < {n} THEN NULL WHEN s.{x}_n = {n} THEN s.{x}_m ELSE r.{out} + (s.{x} - r.{out}) / {n} END",
    )


def wilder_inputs(x: str, n: int) -> str:
    w = "PARTITION BY symbol ORDER BY i"
    return f"count({x}) OVER ({w} ROWS UNBOUNDED PRECEDING) AS {x}_n, avg({x}) OVER ({w} ROWS {n - 1} PRECEDING) AS {x}_m"


def with_(*parts: str, select: str, rec: bool = False) -> str:
    return ("WITH RECURSIVE " if rec else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n" + select
