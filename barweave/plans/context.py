"""Queries: market context, calendar, as-of joins, membership, events and macro series."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions.tables import shared_folder
from barweave.operators import asof, base_features as bf, context as cx, events as ev, macro as mc, membership as mb
from barweave.plans.core import SHAPE, ts
from barweave.plans.registry import query, rounded
from barweave.plans.sqlparts import RETURNS, WEEKLY, with_
from barweave.sources.datasets import fresh_name
from barweave.sources.demo import (
    MACRO_SERIES, SERIES_BY_CUSTOMER, SERIES_BY_PRIORITY, disclosed_trades, macro_long, quarterly_fundamentals, table,
    weekly_bars,
)


def frame_sql(n: int, part: str = "PARTITION BY symbol ") -> str:
    return f"({part}ORDER BY datetime ROWS {n - 1} PRECEDING)"


def guard(agg: str, x: str, n: int, mp: int, part: str = "PARTITION BY symbol ") -> str:
    f = frame_sql(n, part)
    return f"CASE WHEN count({x}) OVER {f} >= {mp} THEN {agg} OVER {f} END"


def zscore(x: str, n: int, mp: int, part: str = "PARTITION BY symbol ") -> str:
    f = frame_sql(n, part)
    return f"CASE WHEN count({x}) OVER {f} >= {mp} THEN ({x} - avg({x}) OVER {f}) / nullif(stddev_samp({x}) OVER {f}, 0) END"


# ---------------------------------------------------------------- market context
MARKET = f"""
daily AS (
  SELECT datetime, avg(close) AS market_close, avg(CASE WHEN ret_1 > 0 THEN 1.0 ELSE 0.0 END) AS breadth_up_share_1,
         avg(CASE WHEN ret_1 < 0 THEN 1.0 ELSE 0.0 END) AS breadth_down_share_1, stddev_samp(ret_1) AS cross_section_dispersion_1
  FROM rets GROUP BY datetime),
m1 AS (
  SELECT *, {", ".join(f"market_close / lag(market_close, {n}) OVER (ORDER BY datetime) - 1 AS market_return_{n}" for n in (1, 5, 10, 20, 63))}
  FROM daily),
m2 AS (
  SELECT *, {guard("stddev_samp(market_return_1)", "market_return_1", 20, 5, "")} AS market_volatility_20,
         {guard("stddev_samp(market_return_1)", "market_return_1", 63, 15, "")} AS market_volatility_63,
         market_close / ({guard("avg(market_close)", "market_close", 20, 5, "")}) - 1 AS market_trend_20,
         market_close / ({guard("max(market_close)", "market_close", 63, 10, "")}) - 1 AS market_drawdown_63,
         {guard("avg(breadth_up_share_1)", "breadth_up_share_1", 20, 5, "")} AS breadth_momentum_20
  FROM m1),
m3 AS (SELECT *, {guard("quantile_cont(market_volatility_20, 0.5)", "market_volatility_20", 252, 30, "")} AS usual FROM m2),
market AS (
  SELECT *, CASE WHEN market_trend_20 > 0 AND market_volatility_20 <= usual THEN 1.0 ELSE 0.0 END AS regime_low_vol_uptrend,
         CASE WHEN market_trend_20 < 0 AND market_volatility_20 > usual THEN 1.0 ELSE 0.0 END AS regime_high_vol_downtrend
  FROM m3)"""

MARKET_COLS = (
    "market_return_1 market_return_5 market_return_10 market_return_20 market_return_63 market_volatility_20 market_volatility_63 "
    "market_trend_20 market_drawdown_63 breadth_up_share_1 breadth_down_share_1 cross_section_dispersion_1 breadth_momentum_20 "
    "regime_low_vol_uptrend regime_high_vol_downtrend"
)


def returns(spark, folder):
    return bf.add_returns(weekly_bars(spark, folder))


def with_context(spark, folder):
    frame = bf.add_shape(returns(spark, folder))
    return cx.add_betas(cx.add_alpha(cx.add_market_context(frame)))


@query("c1_c6_market_table", f"datetime:t market_close:d4 {rounded(MARKET_COLS)}",
       with_(WEEKLY, RETURNS, MARKET, select="SELECT * FROM market"))
def market_table(spark, folder):
    return cx.market_table(returns(spark, folder))


@query("c7_c8_context_alpha", "symbol:i datetime:t alpha_ret_5:d alpha_ret_10:d breadth_edge_1:d market_trend_20:d",
       with_(WEEKLY, RETURNS, MARKET, select="""SELECT r.symbol, r.datetime, ret_5 - market_return_5 AS alpha_ret_5,
       ret_10 - market_return_10 AS alpha_ret_10, CASE WHEN ret_1 > 0 THEN 1.0 ELSE 0.0 END - breadth_up_share_1 AS breadth_edge_1,
       market_trend_20 FROM rets r LEFT JOIN market m USING (datetime)"""))
def context_alpha(spark, folder):
    return cx.add_alpha(cx.add_market_context(returns(spark, folder)))


def beta_sql(n, mp):
    f = frame_sql(n)
    both = "CASE WHEN ret_1 IS NOT NULL AND market_return_1 IS NOT NULL THEN 1 END"
    return (
        f"(CASE WHEN count({both}) OVER {f} >= {mp} THEN covar_samp(ret_1, market_return_1) OVER {f} END)"
        f" / nullif(CASE WHEN count(market_return_1) OVER {f} >= {mp} THEN var_samp(market_return_1) OVER {f} END, 0)"
    )


BETAS = f"""
joined AS (SELECT r.*, m.market_return_1 FROM rets r LEFT JOIN market m USING (datetime)),
betas AS (SELECT *, ret_1 - beta_63 * market_return_1 AS idiosyncratic_return_1
          FROM (SELECT *, {beta_sql(63, 20)} AS beta_63, {beta_sql(20, 10)} AS beta_20 FROM joined))"""


@query("c9_c10_betas", "symbol:i datetime:t " + rounded("beta_63 beta_20 idiosyncratic_return_1 idiosyncratic_vol_20 idiosyncratic_momentum_20", "d5"),
       with_(WEEKLY, RETURNS, MARKET, BETAS, select=f"""SELECT *,
       {guard("stddev_samp(idiosyncratic_return_1)", "idiosyncratic_return_1", 20, 5)} AS idiosyncratic_vol_20,
       {guard("sum(idiosyncratic_return_1)", "idiosyncratic_return_1", 20, 5)} AS idiosyncratic_momentum_20 FROM betas"""))
def betas(spark, folder):
    return with_context(spark, folder)


@query("c11_flow_shock", "symbol:i datetime:t flow_shock_20:d5",
       with_(WEEKLY, RETURNS, SHAPE, select=f"SELECT symbol, datetime, {zscore('dollar_volume', 20, 5)} AS flow_shock_20 FROM shape"))
def flow_shock(spark, folder):
    return cx.add_flow_shock(bf.add_shape(returns(spark, folder)))


def pct_rank_sql(x):
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY datetime ORDER BY {x}) + (count(*) OVER (PARTITION BY datetime, {x}) - 1) / 2.0)"
        f" / count({x}) OVER (PARTITION BY datetime) END"
    )


@query("c12_cross_ranks", "symbol:i datetime:t cs_rank_ret_5:d cs_rank_volatility_20:d", with_(WEEKLY, RETURNS,
       f"v AS (SELECT symbol, datetime, ret_5, {guard('stddev_samp(ret_1)', 'ret_1', 20, 10)} AS vol FROM rets)",
       select=f"SELECT symbol, datetime, {pct_rank_sql('ret_5')} AS cs_rank_ret_5, {pct_rank_sql('vol')} AS cs_rank_volatility_20 FROM v"))
def cross_ranks(spark, folder):
    frame = bf.add_rolling(bf.add_shape(returns(spark, folder)), (20,))
    return cx.add_cross_ranks(frame.select("symbol", "datetime", "ret_5", "volatility_20"))


CAL_COLS = (
    "cal_weekday cal_month cal_weekday_sin cal_weekday_cos cal_month_sin cal_month_cos cal_doy_sin cal_doy_cos "
    "is_month_start is_month_end is_quarter_end is_opex_friday"
)


@query("c13_c14_calendar", f"o_orderkey:i datetime:t {rounded(CAL_COLS)}", """
SELECT o_orderkey, o_orderdate AS datetime, isodow(o_orderdate) - 1 AS cal_weekday, month(o_orderdate) AS cal_month,
       sin(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS cal_weekday_sin, cos(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS cal_weekday_cos,
       sin(2 * pi() * (month(o_orderdate) - 1) / 12) AS cal_month_sin, cos(2 * pi() * (month(o_orderdate) - 1) / 12) AS cal_month_cos,
       sin(2 * pi() * dayofyear(o_orderdate) / 365.25) AS cal_doy_sin, cos(2 * pi() * dayofyear(o_orderdate) / 365.25) AS cal_doy_cos,
       CAST(day(o_orderdate) = 1 AS INT) AS is_month_start, CAST(CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS INT) AS is_month_end,
       CAST(CAST(o_orderdate AS DATE) = last_day(o_orderdate) AND month(o_orderdate) % 3 = 0 AS INT) AS is_quarter_end,
       CAST(isodow(o_orderdate) = 5 AND day(o_orderdate) BETWEEN 15 AND 21 AS INT) AS is_opex_friday FROM orders""")
def calendar(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("datetime"))
    return cx.add_calendar(orders)


# ---------------------------------------------------------------- as-of joins
FUND = """
fund AS (
  SELECT symbol, CAST(last_day(quarter_start + INTERVAL 2 MONTH) AS TIMESTAMP) AS asof_datetime, revenue,
         CASE WHEN (symbol + quarter(quarter_start)) % 4 <> 0 THEN mean_discount END AS mean_discount, line_count
  FROM (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS quarter_start,
               sum(l_extendedprice) AS revenue, avg(l_discount) AS mean_discount, CAST(count(*) AS DOUBLE) AS line_count
        FROM lineitem GROUP BY 1, 2))"""


@query("j1_asof_fundamentals", "symbol:i datetime:t close:x asof_datetime:t revenue:d2 mean_discount:d line_count:x",
       with_(WEEKLY, FUND, select="SELECT b.*, f.* EXCLUDE symbol FROM bars b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.datetime >= f.asof_datetime"))
def asof_fundamentals(spark, folder):
    return asof.asof_join(weekly_bars(spark, folder), quarterly_fundamentals(spark, folder), ["symbol"])


@query("j1_asof_raw_prints", "l_orderkey:i l_linenumber:i l_partkey:i symbol:i datetime:t asof_datetime:t revenue:d2 mean_discount:d",
       with_(FUND, select="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS symbol, l_shipdate AS datetime, f.asof_datetime, f.revenue, f.mean_discount
       FROM lineitem l ASOF LEFT JOIN fund f ON l.l_suppkey = f.symbol AND l.l_shipdate >= f.asof_datetime"""))
def asof_raw(spark, folder):
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("datetime")
    )
    return asof.asof_range(li, quarterly_fundamentals(spark, folder), ["symbol"])


TRADES = """
trades AS (
  SELECT l_suppkey AS symbol, l_shipdate AS trade_date, l_extendedprice AS amount_usd,
         CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'other' END AS side,
         l_partkey AS politician, CASE l_linestatus WHEN 'O' THEN 'senate' ELSE 'house' END AS chamber,
         l_discount * 100 AS disclosure_lag_days FROM lineitem),
signed AS (SELECT *, CASE side WHEN 'buy' THEN amount_usd WHEN 'sell' THEN -amount_usd ELSE 0 END AS s FROM trades),
daily_trades AS (
  SELECT symbol, trade_date, sum(s) AS politician_signed_flow, sum(amount_usd) AS politician_abs_flow, count(amount_usd) AS politician_trade_count,
         CAST(count(*) FILTER (WHERE side = 'buy') AS DOUBLE) AS politician_buy_count, CAST(count(*) FILTER (WHERE side = 'sell') AS DOUBLE) AS politician_sell_count,
         count(DISTINCT politician) AS politician_unique_count, avg(disclosure_lag_days) AS politician_disclosure_lag_days,
         sum(CASE WHEN chamber = 'senate' THEN s ELSE 0 END) AS politician_senate_signed_flow,
         sum(CASE WHEN chamber = 'house' THEN s ELSE 0 END) AS politician_house_signed_flow,
         CAST(count(*) FILTER (WHERE chamber = 'senate') AS DOUBLE) AS politician_senate_trade_count,
         CAST(count(*) FILTER (WHERE chamber = 'house') AS DOUBLE) AS politician_house_trade_count
  FROM signed GROUP BY 1, 2)"""

DAILY_COLS = (
    "politician_trade_count:i politician_buy_count:x politician_sell_count:x politician_unique_count:i politician_disclosure_lag_days:d "
    "politician_signed_flow:d2 politician_abs_flow:d2 politician_senate_signed_flow:d2 politician_house_signed_flow:d2 "
    "politician_senate_trade_count:x politician_house_trade_count:x"
)


def time_window(days):
    return f"(PARTITION BY symbol ORDER BY trade_date RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND CURRENT ROW)"


# dates carry no time of day, so the half-open 30-day frame equals a closed 29-day one
ROLLED = "rolled AS (SELECT *, " + ", ".join(
    f"sum({c}) OVER {time_window(d)} AS {n}" for n, (c, d) in ev.TRADE_ROLLS.items()
) + f", avg(politician_disclosure_lag_days) OVER {time_window(30)} AS politician_disclosure_lag_30d FROM daily_trades)"

ROLL_SPEC = " ".join(f"{n}:{'d2' if 'flow' in n else 'x'}" for n in ev.TRADE_ROLLS)


@query("e15_daily_trades", f"symbol:i trade_date:t {DAILY_COLS}", with_(TRADES, select="SELECT * FROM daily_trades"))
def daily_trades(spark, folder):
    return ev.daily_trades(disclosed_trades(spark, folder))


@query("e16_rolling_trades", f"symbol:i trade_date:t {ROLL_SPEC} politician_disclosure_lag_30d:d politician_buy_sell_ratio_30d:d politician_flow_imbalance_30d:d",
       with_(TRADES, ROLLED, select="""SELECT *, politician_buy_count_30d / (politician_sell_count_30d + 1) AS politician_buy_sell_ratio_30d,
       politician_flow_30d / nullif(politician_abs_flow_30d, 0) AS politician_flow_imbalance_30d FROM rolled"""))
def rolling_trades(spark, folder):
    return ev.rolling_trades(ev.daily_trades(disclosed_trades(spark, folder)))


@query("j2_asof_trades", "symbol:i datetime:t trade_date:t politician_flow_30d:d2 politician_signed_flow:d2", with_(WEEKLY, TRADES, ROLLED, select="""
       SELECT b.symbol, b.datetime, r.trade_date, r.politician_flow_30d, r.politician_signed_flow
       FROM bars b ASOF LEFT JOIN rolled r ON b.symbol = r.symbol AND b.datetime >= r.trade_date"""))
def asof_trades(spark, folder):
    rolled = ev.rolling_trades(ev.daily_trades(disclosed_trades(spark, folder))).select(
        "symbol", "trade_date", "politician_flow_30d", "politician_signed_flow"
    )
    return asof.asof_latest(weekly_bars(spark, folder), rolled, ["symbol"])


@query("j9_semi_anti", "c_custkey:i side:s", """
SELECT c_custkey, 'with' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_anti(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey")
    keys = table(spark, folder, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return people.join(keys, "c_custkey", "left_semi").withColumn("side", F.lit("with")).unionByName(
        people.join(keys, "c_custkey", "left_anti").withColumn("side", F.lit("without"))
    )


# ---------------------------------------------------------------- membership
INTERVALS = """
raw_iv AS (
  SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS start_date,
         CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) + INTERVAL 14 DAY * CAST(1 + min(l_linenumber) % 4 AS INT) AS end_date
  FROM lineitem GROUP BY 1, 2),
edges AS (SELECT *, max(end_date) OVER (PARTITION BY symbol ORDER BY start_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM raw_iv),
merged AS (
  SELECT symbol, min(start_date) AS start_date, max(end_date) AS end_date
  FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_date > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start_date) AS island FROM edges)
  GROUP BY symbol, island)"""


def raw_intervals(spark, folder):
    li = table(spark, folder, "lineitem")
    month = F.date_trunc("month", "l_shipdate")
    per_month = li.groupBy(F.col("l_suppkey").alias("symbol"), month.alias("start_date")).agg(F.min("l_linenumber").alias("_n"))
    days = (F.lit(14) * (F.lit(1) + F.col("_n") % 4)).cast("int")
    return per_month.select("symbol", "start_date", F.timestamp_add("DAY", days, F.col("start_date")).alias("end_date"))


@query("u1_merge_intervals", "symbol:i start_date:t end_date:t", with_(INTERVALS, select="SELECT * FROM merged"))
def merge_intervals(spark, folder):
    return mb.merge_intervals(raw_intervals(spark, folder))


@query("u4_j7_membership_filter", "symbol:i datetime:t close:x", with_(WEEKLY, INTERVALS, select="""
       SELECT * FROM bars b WHERE EXISTS (SELECT 1 FROM merged i WHERE i.symbol = b.symbol AND b.datetime >= i.start_date AND b.datetime < i.end_date)"""))
def membership_filter(spark, folder):
    return mb.filter_by_membership(weekly_bars(spark, folder), raw_intervals(spark, folder))


# The twin walks the log recursively, one event at a time, instead of pairing it with windows.
@query("u2_intervals_from_changes", "symbol:s start_date:t end_date:t", """
WITH RECURSIVE log AS (
  SELECT DISTINCT 'S' || (o_custkey % 97) AS symbol, o_orderdate AS d, 0 AS k FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT DISTINCT 'S' || (o_custkey % 97), o_orderdate, 1 FROM orders WHERE o_orderpriority = '2-HIGH'),
nums AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC, k) AS i FROM log),
members AS (SELECT 'S' || (c_custkey % 97) AS symbol FROM customer WHERE c_custkey % 97 < 50 UNION SELECT 'S' || 'X' WHERE false),
walk AS (
  SELECT s.symbol, CAST(0 AS BIGINT) AS i, s.symbol IN (SELECT symbol FROM members) AS active, TIMESTAMP '2002-01-01' AS until,
         CAST(NULL AS TIMESTAMP) AS out_start, CAST(NULL AS TIMESTAMP) AS out_end
  FROM (SELECT symbol FROM nums UNION SELECT symbol FROM members) s
  UNION ALL
  SELECT w.symbol, n.i, n.k = 1 OR (w.active AND n.k <> 0),
         CASE WHEN NOT w.active AND n.k = 1 THEN n.d ELSE w.until END,
         CASE WHEN w.active AND n.k = 0 THEN n.d END, CASE WHEN w.active AND n.k = 0 THEN w.until END
  FROM walk w JOIN nums n ON n.symbol = w.symbol AND n.i = w.i + 1),
found AS (
  SELECT symbol, out_start AS start_date, out_end AS end_date FROM walk WHERE out_end > out_start
  UNION ALL
  SELECT symbol, TIMESTAMP '1900-01-01', arg_max(until, i) FROM walk GROUP BY symbol HAVING arg_max(active, i)),
edges AS (SELECT *, max(end_date) OVER (PARTITION BY symbol ORDER BY start_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found)
SELECT symbol, min(start_date) AS start_date, max(end_date) AS end_date
FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_date > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start_date) AS island FROM edges)
GROUP BY symbol, island""")
def intervals_from_changes(spark, folder):
    orders = table(spark, folder, "orders")
    name = F.concat(F.lit("S"), F.col("o_custkey") % 97)
    urgent = F.col("o_orderpriority")
    changes = orders.where(urgent.isin("1-URGENT", "2-HIGH")).select(
        F.col("o_orderdate").alias("effective_date"),
        F.when(urgent == "1-URGENT", name).alias("added"),
        F.when(urgent == "2-HIGH", name).alias("removed"),
    )
    members = table(spark, folder, "customer").where(F.col("c_custkey") % 97 < 50)
    current = members.select(F.concat(F.lit("S"), F.col("c_custkey") % 97).alias("symbol"))
    return mb.intervals_from_changes(changes, current, ts("2002-01-01"))


@query("u3_static_intervals", "symbol:i start_date:t end_date:t",
       "SELECT DISTINCT s_suppkey AS symbol, TIMESTAMP '1900-01-01' AS start_date, TIMESTAMP '2002-01-01' AS end_date FROM supplier")
def static_intervals(spark, folder):
    return mb.static_intervals(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("symbol")), ts("2002-01-01"))


@query("s6_membership_csv", "symbol:s start_date:t end_date:t",
       with_(INTERVALS, select="SELECT 'S' || symbol AS symbol, start_date, end_date FROM merged"))
def membership_csv(spark, folder):
    path = f"{shared_folder(spark)}/membership/{fresh_name()}"
    named = raw_intervals(spark, folder).withColumn("symbol", F.concat(F.lit("s"), F.col("symbol")))
    mb.write_membership(named, path)
    return mb.read_membership(spark, path)


# ---------------------------------------------------------------- macro
def _series_sql():
    cust = ", ".join(f"'{s}'" for s in SERIES_BY_CUSTOMER)
    prio = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SERIES_BY_PRIORITY.items())
    return f"""
series_long AS (
  SELECT datetime, series, avg(value) AS value FROM (
    SELECT o_orderdate AS datetime, o_totalprice / 100000.0 AS value, ([{cust}])[o_custkey % 12 + 1] AS series FROM orders
    UNION ALL SELECT o_orderdate, o_totalprice / 100000.0, CASE o_orderpriority {prio} END FROM orders
    UNION ALL SELECT o_orderdate, o_totalprice / 100000.0, 'macro_tsy_5y' FROM orders WHERE o_orderstatus = 'P')
  WHERE series IS NOT NULL GROUP BY 1, 2),
wide AS (
  SELECT datetime, {", ".join(f"max(value) FILTER (WHERE series = '{s}') AS {s}" for s in MACRO_SERIES)} FROM series_long GROUP BY 1),
spine AS (
  SELECT CAST(unnest(generate_series(min(o_orderdate) - INTERVAL 400 DAY, max(o_orderdate), INTERVAL 1 DAY)) AS TIMESTAMP) AS datetime FROM orders),
filled AS (
  SELECT datetime, {", ".join(f"last_value({s} IGNORE NULLS) OVER (ORDER BY datetime ROWS BETWEEN 366 PRECEDING AND CURRENT ROW) AS {s}" for s in MACRO_SERIES)}
  FROM spine LEFT JOIN wide USING (datetime))"""


MACRO = _series_sql()


def spine(spark, folder):
    orders = table(spark, folder, "orders")
    return mc.daily_spine(orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")))


def macro_filled(spark, folder):
    wide = mc.series_to_wide(macro_long(spark, folder), list(MACRO_SERIES))
    return mc.forward_fill(mc.on_spine(spine(spark, folder), wide), list(MACRO_SERIES))


@query("s10_series_to_wide", f"datetime:t {rounded(' '.join(MACRO_SERIES))}", with_(MACRO, select="SELECT * FROM wide"))
def series_to_wide(spark, folder):
    return mc.series_to_wide(macro_long(spark, folder), list(MACRO_SERIES))


@query("m1_m3_spine_fill", f"datetime:t {rounded(' '.join(MACRO_SERIES))}", with_(MACRO, select="SELECT * FROM filled"))
def spine_fill(spark, folder):
    return macro_filled(spark, folder)


def calendar_rows(spark, folder):
    """Release calendar from orders: name, country, impact and printed numbers."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    event = F.when(k % 9 == 0, "CPI (YoY)").when(k % 9 == 1, "Non Farm Payrolls").otherwise("Housing Starts")
    country = F.when(k % 4 == 0, "US").when(k % 4 == 1, "usa").when(k % 4 == 2, "United States").otherwise("DE")
    impact = F.when(F.col("o_orderpriority") == "1-URGENT", "High").when(F.col("o_orderpriority") == "2-HIGH", "Medium").otherwise("Low")
    price = F.col("o_totalprice")
    return o.select(
        F.col("o_orderdate").alias("datetime"),
        event.alias("event"),
        country.alias("country"),
        impact.alias("impact"),
        F.concat(F.format_number(F.floor(price), 0)).alias("actual"),
        F.when(k % 3 == 0, F.concat(F.floor(price / 900.0), F.lit("K"))).otherwise("n/a").alias("estimate"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.floor(price / 1100.0), F.lit("k"))).alias("previous"),
    )


CAL_SQL = """
cal AS (
  SELECT o_orderdate AS datetime, o_orderkey % 9 IN (0, 1) AS is_major,
         CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END AS impact_score,
         floor(o_totalprice) AS actual,
         coalesce(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice / 900.0) * 1000 END,
                  CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 1100.0) * 1000 END) AS base
  FROM orders WHERE o_orderkey % 4 <> 3),
scored AS (SELECT *, CASE WHEN abs(base) > 1e-9 THEN (actual - base) / abs(base) END AS surprise FROM cal)"""

CAL_DAILY = """
cal_daily AS (
  SELECT datetime, count(*) AS n, count(*) FILTER (WHERE impact_score >= 3) AS high, count(*) FILTER (WHERE is_major) AS major,
         avg(surprise) AS macro_us_event_surprise_mean, avg(abs(surprise)) AS macro_us_event_abs_surprise_mean FROM scored GROUP BY 1),
cal_spine AS (
  SELECT datetime, coalesce(n, 0) AS macro_us_event_count, coalesce(high, 0) AS macro_us_high_impact_count,
         coalesce(major, 0) AS macro_us_major_event_count, macro_us_event_surprise_mean, macro_us_event_abs_surprise_mean
  FROM spine LEFT JOIN cal_daily USING (datetime))"""


@query("m4_score_calendar", "datetime:t is_major:s impact_score:x surprise:d events:i", with_(CAL_SQL, select="""
       SELECT datetime, CAST(is_major AS VARCHAR) AS is_major, impact_score, surprise, count(*) AS events FROM scored GROUP BY 1, 2, 3, 4"""))
def score_calendar(spark, folder):
    scored = mc.score_calendar(calendar_rows(spark, folder))
    return scored.groupBy("datetime", "is_major", "impact_score", "surprise").agg(F.count(F.lit(1)).alias("events"))


EVENT_SPEC = (
    "macro_us_event_count:x macro_us_high_impact_count:x macro_us_major_event_count:x macro_us_event_surprise_mean:d "
    "macro_us_event_abs_surprise_mean:d macro_us_event_count_5d:x macro_us_high_impact_count_5d:x macro_us_major_event_count_5d:x "
    "macro_us_abs_surprise_5d:d macro_us_abs_surprise_21d:d macro_days_since_us_major_event:x macro_days_to_next_us_major_event:x"
)


def roll5(c):
    return f"sum({c}) OVER (ORDER BY datetime ROWS 4 PRECEDING) AS {c}_5d"


@query("m5_m7_event_features", f"datetime:t {EVENT_SPEC}", with_(MACRO, CAL_SQL, CAL_DAILY, select=f"""
SELECT *, {roll5("macro_us_event_count")}, {roll5("macro_us_high_impact_count")}, {roll5("macro_us_major_event_count")},
       {guard("avg(macro_us_event_abs_surprise_mean)", "macro_us_event_abs_surprise_mean", 5, 1, "")} AS macro_us_abs_surprise_5d,
       {guard("avg(macro_us_event_abs_surprise_mean)", "macro_us_event_abs_surprise_mean", 21, 3, "")} AS macro_us_abs_surprise_21d,
       least(999, coalesce(date_diff('day', max(CASE WHEN macro_us_major_event_count > 0 THEN datetime END) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING), datetime), 999)) AS macro_days_since_us_major_event,
       least(999, coalesce(date_diff('day', datetime, min(CASE WHEN macro_us_major_event_count > 0 THEN datetime END) OVER (ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 999)) AS macro_days_to_next_us_major_event
FROM cal_spine"""))
def event_features(spark, folder):
    return mc.event_features(calendar_rows(spark, folder), spine(spark, folder))


CURVE = """
curve0 AS (
  SELECT *, macro_fred_dgs10 - macro_fred_dgs2 AS macro_curve_10y_2y, macro_fred_dgs10 - macro_fred_dgs3m AS macro_curve_10y_3m,
         2 * macro_tsy_5y - macro_fred_dgs2 - macro_fred_dgs10 AS macro_curve_curvature_5s10s2s,
         CASE WHEN macro_fred_dgs10 - macro_fred_dgs2 < 0 THEN 1.0 ELSE 0.0 END AS macro_curve_inversion_10y_2y,
         CASE WHEN macro_fred_dgs10 - macro_fred_dgs3m < 0 THEN 1.0 ELSE 0.0 END AS macro_curve_inversion_10y_3m FROM filled),
curve1 AS (SELECT *, sum(1 - macro_curve_inversion_10y_2y) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS run FROM curve0),
curve AS (SELECT * EXCLUDE run, sum(macro_curve_inversion_10y_2y) OVER (PARTITION BY run ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS macro_curve_inversion_days_10y_2y FROM curve1)"""


@query("m8_yield_curve", "datetime:t " + rounded("macro_curve_10y_2y macro_curve_10y_3m macro_curve_curvature_5s10s2s "
       "macro_curve_inversion_10y_2y macro_curve_inversion_10y_3m macro_curve_inversion_days_10y_2y"),
       with_(MACRO, CURVE, select="SELECT * FROM curve"))
def yield_curve(spark, folder):
    return mc.add_yield_curve(macro_filled(spark, folder))


@query("m9_ratios", "datetime:t " + rounded("macro_equity_bond_ratio macro_small_large_ratio macro_credit_risk_ratio "
       "macro_equity_risk_premium_total macro_erp_vs_equity_momentum"), with_(MACRO, select="""
       SELECT datetime, macro_proxy_spy / macro_proxy_tlt AS macro_equity_bond_ratio, macro_proxy_iwm / macro_proxy_qqq AS macro_small_large_ratio,
              macro_proxy_hyg / macro_proxy_lqd AS macro_credit_risk_ratio,
              macro_fmp_market_risk_premium + macro_fmp_risk_free_rate AS macro_equity_risk_premium_total,
              macro_fmp_market_risk_premium - (macro_proxy_spy / lag(macro_proxy_spy, 20) OVER (ORDER BY datetime) - 1) AS macro_erp_vs_equity_momentum
       FROM filled"""))
def ratios(spark, folder):
    return mc.add_ratios(macro_filled(spark, folder))


SECTOR = """
sector0 AS (
  SELECT *, list_filter([macro_sector_perf_a, macro_sector_perf_b], lambda x : x IS NOT NULL) AS f,
         list_filter([macro_sector_pe_a, macro_sector_pe_b], lambda x : x IS NOT NULL) AS p FROM {source}),
sector AS (
  SELECT *, list_avg(f) AS macro_sector_perf_mean, CASE WHEN len(f) > 1 THEN list_stddev_samp(f) END AS macro_sector_perf_std,
         list_max(f) - list_min(f) AS macro_sector_perf_spread,
         (CASE WHEN macro_sector_perf_a > 0 THEN 0.5 ELSE 0 END) + (CASE WHEN macro_sector_perf_b > 0 THEN 0.5 ELSE 0 END) AS macro_sector_positive_share,
         list_avg(p) AS macro_sector_pe_mean, CASE WHEN len(p) > 1 THEN list_stddev_samp(p) END AS macro_sector_pe_std,
         list_max(p) - list_min(p) AS macro_sector_pe_spread FROM sector0)"""


@query("m10_p12_sectors", "datetime:t " + rounded("macro_sector_perf_mean macro_sector_perf_std macro_sector_perf_spread macro_sector_positive_share "
       "macro_sector_pe_mean macro_sector_pe_std macro_sector_pe_spread macro_sector_perf_to_pe macro_sector_dispersion_blend"),
       with_(MACRO, SECTOR.format(source="filled"), select="""SELECT *, macro_sector_perf_mean / nullif(macro_sector_pe_mean, 0) AS macro_sector_perf_to_pe,
       list_avg(list_filter([macro_sector_perf_std, macro_sector_pe_std], lambda x : x IS NOT NULL)) AS macro_sector_dispersion_blend FROM sector"""))
def sectors(spark, folder):
    return mc.add_sectors(macro_filled(spark, folder))


PROXIES = [s for s in MACRO_SERIES if s.startswith("macro_proxy_")]


@query("m11_proxy_returns", "datetime:t " + rounded(" ".join(f"{p}_ret_{n}" for p in PROXIES for n in (1, 5, 20))),
       with_(MACRO, select="SELECT datetime, " + ", ".join(
           f"{p} / lag({p}, {n}) OVER (ORDER BY datetime) - 1 AS {p}_ret_{n}" for p in PROXIES for n in (1, 5, 20)) + " FROM filled"))
def proxy_returns(spark, folder):
    return mc.add_proxy_returns(macro_filled(spark, folder))


STATE_SQL = [
    "macro_fred_vix", "-macro_curve_10y_2y", "-macro_curve_10y_3m", "-macro_proxy_spy_ret_5", "macro_sector_perf_std",
    "-macro_sector_positive_share", "macro_fmp_market_risk_premium",
]
RISK = SECTOR.format(source="curve").strip() + f""",
states AS (SELECT *, macro_proxy_spy / lag(macro_proxy_spy, 5) OVER (ORDER BY datetime) - 1 AS macro_proxy_spy_ret_5 FROM sector),
zs AS (SELECT *, [{", ".join(zscore("(" + s + ")", 63, 21, "") for s in STATE_SQL)}] AS z FROM states),
risk AS (SELECT *, list_avg(list_filter(z, lambda x : x IS NOT NULL)) AS macro_risk_off_score FROM zs)"""

SHOCK = f"""
shock0 AS (SELECT *, macro_fred_cpi - lag(macro_fred_cpi) OVER (ORDER BY datetime) AS d FROM risk),
shock1 AS (SELECT *, {guard("quantile_cont(d, 0.5)", "d", 12, 4, "")} AS med, {guard("stddev_samp(d)", "d", 24, 6, "")} AS sd FROM shock0),
shock AS (SELECT *, (d - lag(med) OVER (ORDER BY datetime)) / nullif(lag(sd) OVER (ORDER BY datetime), 0) AS macro_surprise_index FROM shock1)"""


@query("m12_risk_off", "datetime:t macro_risk_off_score:d5 macro_regime_risk_off:x macro_regime_high_stress:x",
       with_(MACRO, CURVE, RISK, select="""SELECT datetime, macro_risk_off_score, CASE WHEN macro_risk_off_score > 0.5 THEN 1.0 ELSE 0.0 END AS macro_regime_risk_off,
       CASE WHEN macro_risk_off_score > 1.0 THEN 1.0 ELSE 0.0 END AS macro_regime_high_stress FROM risk"""))
def risk_off(spark, folder):
    return mc.derive_macro(macro_filled(spark, folder))


@query("m13_m14_surprise", "datetime:t " + rounded("macro_fred_cpi_surprise macro_surprise_index macro_surprise_abs_index macro_surprise_index_z_63 "
       "macro_surprise_abs_index_z_63", "d5"),
       with_(MACRO, CURVE, RISK, SHOCK, f"shock2 AS (SELECT *, abs(macro_surprise_index) AS macro_surprise_abs_index FROM shock)", select=f"""
       SELECT datetime, macro_surprise_index AS macro_fred_cpi_surprise, macro_surprise_index, macro_surprise_abs_index,
              {zscore("macro_surprise_index", 63, 21, "")} AS macro_surprise_index_z_63,
              {zscore("macro_surprise_abs_index", 63, 21, "")} AS macro_surprise_abs_index_z_63 FROM shock2"""))
def surprise(spark, folder):
    return mc.derive_macro(macro_filled(spark, folder))


@query("m14_index_z", "datetime:t macro_risk_off_score_z_63:d5",
       with_(MACRO, CURVE, RISK, select=f"SELECT datetime, {zscore('macro_risk_off_score', 63, 21, '')} AS macro_risk_off_score_z_63 FROM risk"))
def index_z(spark, folder):
    return mc.derive_macro(macro_filled(spark, folder))


@query("j3_asof_macro", "symbol:i datetime:t close:x macro_proxy_spy:d macro_fred_vix:d", with_(WEEKLY, MACRO, select="""
       SELECT b.symbol, b.datetime, b.close, w.macro_proxy_spy, w.macro_fred_vix FROM bars b
       ASOF LEFT JOIN (SELECT datetime AS asof, macro_proxy_spy, macro_fred_vix FROM wide) w ON b.datetime >= w.asof"""))
def asof_macro(spark, folder):
    wide = mc.series_to_wide(macro_long(spark, folder), list(MACRO_SERIES)).select("datetime", "macro_proxy_spy", "macro_fred_vix")
    return asof.asof_by_date(weekly_bars(spark, folder), wide)


@query("j4_j5_date_joins", "datetime:t orders:i lines:i", """
SELECT coalesce(o.datetime, l.datetime) AS datetime, o.orders, l.lines FROM
  (SELECT o_orderdate AS datetime, count(*) AS orders FROM orders GROUP BY 1) o FULL JOIN
  (SELECT l_shipdate AS datetime, count(*) AS lines FROM lineitem GROUP BY 1) l ON o.datetime = l.datetime""".replace("o.orders, l.lines", "coalesce(o.orders, 0) AS orders, coalesce(l.lines, 0) AS lines"))
def date_joins(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.col("o_orderdate").alias("datetime")).agg(F.count(F.lit(1)).alias("orders"))
    l = table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").alias("datetime")).agg(F.count(F.lit(1)).alias("lines"))
    return o.join(l, "datetime", "full_outer").fillna(0)
