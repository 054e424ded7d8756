"""Queries over weekly bars: sources, cleaning, patterns, base features, labels, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions.tables import settle, shared_folder
from barweave.functions.missing import finite_frame
from barweave.operators import base_features as bf, labels as lb, patterns as pt, signals as sg
from barweave.plans.registry import query, rounded
from barweave.plans.sqlparts import (
    BLIND, EVENT_DAY, FLAGS, FUTURE, MEMBERS, PATTERN_NAMES, REALIZED, RETURNS, TRADE_METRICS, WEEKLY,
    metrics_sql, with_,
)
from barweave.sources import bars as sb, datasets as sd
from barweave.sources.demo import event_day_bars, table, weekly_bars

BAR = "symbol:i datetime:t open:x high:x low:x close:x volume:x"


def ts(text: str):
    return F.lit(text).cast("timestamp")


# ---------------------------------------------------------------- sources
@query("s1_bar_scan", BAR, with_(WEEKLY, select="SELECT * FROM bars"))
def bar_scan(spark, folder):
    return weekly_bars(spark, folder)


@query("s2_bar_store_roundtrip", BAR + " interval:s",
       with_(WEEKLY, EVENT_DAY, select="SELECT * REPLACE (CASE WHEN symbol % 3 = 0 THEN volume * 2 ELSE volume END AS volume), '1d' AS interval FROM day_bars"))
def bar_store(spark, folder):
    path = f"{shared_folder(spark)}/bars/{sd.fresh_name()}"
    sb.save_bars(weekly_bars(spark, folder), path, "1wk")
    days = event_day_bars(spark, folder)
    sb.save_bars(days, path, "1d")
    # some symbols come again and take the place of what is stored
    sb.save_bars(days.where(F.col("symbol") % 3 == 0).withColumn("volume", F.col("volume") * 2), path, "1d")
    return sb.scan_bars(spark, path, "1d")


@query("s3_dataset_roundtrip", BAR + " pattern:s " + rounded(" ".join(f"pattern_{p}" for p in PATTERN_NAMES), "i"),
       with_(WEEKLY, FLAGS, select="SELECT * FROM labeled"))
def dataset_roundtrip(spark, folder):
    path = f"{shared_folder(spark)}/datasets"
    name = sd.fresh_name()
    sd.save_dataset(pt.add_patterns(weekly_bars(spark, folder)), path, name)
    return sd.load_dataset(spark, path, name)


@query("s8_vendor_mapping", BAR.replace(":x", ":d") , with_(EVENT_DAY, select="SELECT * FROM day_bars"))
def vendor_mapping(spark, folder):
    raw = event_day_bars(spark, folder).select(
        "symbol",
        F.unix_millis("datetime").alias("t"),
        F.col("open").alias("o"),
        F.col("high").alias("h"),
        F.col("low").alias("l"),
        F.col("close").alias("c"),
        F.col("volume").alias("v"),
    )
    return sb.from_vendor(raw, F.col("symbol"))


@query("s12_dataset_profile",
       "rows:i symbols:i first_datetime:t last_datetime:t columns:i has_labels:i",
       with_(WEEKLY, select="""SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(datetime) AS first_datetime,
       max(datetime) AS last_datetime, 7 AS columns, 0 AS has_labels FROM bars"""))
def dataset_profile(spark, folder):
    return sd.profile(weekly_bars(spark, folder))


# ---------------------------------------------------------------- cleaning
RAW_EVENTS = """
raw AS (
  SELECT user_id AS symbol, CAST(ts AS DATE) AS day, event_id,
         value AS o, value * 1.5 AS h, value * 0.5 AS l, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * 1.25 END AS c,
         CASE WHEN event_id % 5 = 0 THEN value * 0.75 WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS a,
         CAST(event_id % 100 AS DOUBLE) AS v
  FROM events),
clean AS (
  SELECT symbol, day, first(o ORDER BY event_id) AS o, first(h ORDER BY event_id) AS h, first(l ORDER BY event_id) AS l,
         first(c ORDER BY event_id) AS c, first(a ORDER BY event_id) AS a, first(v ORDER BY event_id) AS v
  FROM raw WHERE c IS NOT NULL AND o IS NOT NULL GROUP BY symbol, day)"""


@query("p1_p2_normalize_adjusted", BAR.replace(":x", ":d"),
       with_(RAW_EVENTS, select="""SELECT symbol, CAST(day AS TIMESTAMP) AS datetime,
       o * f AS open, h * f AS high, l * f AS low, CASE WHEN good THEN a ELSE c END AS close, v AS volume
       FROM (SELECT *, c > 0 AND a > 0 AS good, CASE WHEN c > 0 AND a > 0 THEN a / c ELSE 1.0 END AS f FROM clean)"""))
def normalize_adjusted(spark, folder):
    ev = table(spark, folder, "events")
    v, i = F.col("value"), F.col("event_id")
    raw = ev.select(
        F.col("user_id").alias("symbol"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        v.alias("Open"),
        (v * 1.5).alias("High"),
        (v * 0.5).alias("Low"),
        F.when(i % 17 == 0, F.lit("n/a")).otherwise((v * 1.25).cast("string")).alias("Close"),
        F.when(i % 5 == 0, v * 0.75).when(i % 7 == 0, 0.0).otherwise(v).alias("Adj Close"),
        (i % 100).cast("double").alias("Volume"),
        i,
    )
    return sb.normalize_bars(raw, order=[F.col("event_id")])


@query("p3_clip_years", BAR,
       with_(WEEKLY, select="SELECT * FROM bars WHERE datetime >= TIMESTAMP '2002-01-01' - INTERVAL 3 YEAR"))
def clip_years(spark, folder):
    return sb.clip_years(weekly_bars(spark, folder), 3, F.lit("2002-01-01").cast("date"))


@query("p4_years_ago_window", BAR, with_(WEEKLY, select="""SELECT * FROM bars WHERE CAST(datetime AS DATE)
       BETWEEN DATE '1998-01-01' AND DATE '2000-01-01'"""))
def years_ago(spark, folder):
    return sb.years_ago_window(weekly_bars(spark, folder), 2, 4, F.lit("2002-01-01").cast("date"))


@query("p5_minimum_history", BAR, with_(EVENT_DAY, select="""SELECT * EXCLUDE n FROM
       (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM day_bars) WHERE n >= 27"""))
def minimum_history(spark, folder):
    return sb.minimum_history(event_day_bars(spark, folder), 27)


@query("p14_infinity_to_null", "event_id:i user_id:i v:d", """SELECT event_id, user_id,
       CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 10 = 3 THEN NULL ELSE value / (event_id % 10 - 3) END AS v FROM events""")
def infinity_to_null(spark, folder):
    i = F.col("event_id")
    ratio = F.when(i % 11 == 0, F.lit(float("inf"))).when(i % 13 == 0, F.lit(float("nan"))).otherwise(
        F.try_divide(F.col("value"), i % 10 - 3)
    )
    return finite_frame(table(spark, folder, "events").select("event_id", "user_id", ratio.alias("v")))


@query("p15_most_recent_rows", BAR,
       with_(WEEKLY, select="SELECT * FROM bars ORDER BY datetime DESC, symbol LIMIT 250"))
def most_recent(spark, folder):
    return sb.most_recent(weekly_bars(spark, folder), 250)


@query("p16_feature_columns", "feature:s filled:i",
       with_(WEEKLY, RETURNS, select="""UNPIVOT (SELECT count(ret_1) AS ret_1, count(ret_2) AS ret_2, count(ret_3) AS ret_3,
       count(ret_5) AS ret_5, count(ret_10) AS ret_10, count(log_ret_1) AS log_ret_1 FROM rets)
       ON COLUMNS(*) INTO NAME feature VALUE filled"""))
def feature_columns(spark, folder):
    frame = bf.add_returns(weekly_bars(spark, folder))
    names = sd.feature_columns(frame)
    counts = frame.agg(F.lit(0).alias("_k"), *[F.count(c).alias(c) for c in names])
    return counts.unpivot(["_k"], names, "feature", "filled")


# ---------------------------------------------------------------- patterns
FLAG_COLS = rounded(" ".join(f"pattern_{p}" for p in PATTERN_NAMES), "i")


@query("k1_k11_patterns", f"symbol:i datetime:t {FLAG_COLS}", with_(WEEKLY, FLAGS, select="SELECT * FROM labeled"))
def patterns(spark, folder):
    return pt.add_patterns(weekly_bars(spark, folder))


@query("k1_k11_patterns_events", f"symbol:i datetime:t {FLAG_COLS} pattern:s",
       with_(EVENT_DAY, "bars AS (SELECT * FROM day_bars)", FLAGS, select="SELECT * FROM labeled"))
def patterns_events(spark, folder):
    return pt.add_patterns(event_day_bars(spark, folder))


@query("k12_primary_pattern", "symbol:i datetime:t pattern:s",
       with_(WEEKLY, FLAGS, select="SELECT symbol, datetime, pattern FROM labeled"))
def primary_pattern(spark, folder):
    return pt.add_patterns(weekly_bars(spark, folder))


@query("k13_pattern_hits", "symbol:i datetime:t close:x",
       with_(WEEKLY, FLAGS, select="SELECT * FROM labeled WHERE pattern_doji = 1"))
def pattern_hits(spark, folder):
    return pt.pattern_hits(pt.add_patterns(weekly_bars(spark, folder)), "doji")


@query("k14_pattern_fan_out", "member:s symbol:i datetime:t close:x", with_(WEEKLY, FLAGS, MEMBERS, select="""
       SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY member) AS n FROM members) WHERE n >= 100"""))
def fan_out(spark, folder):
    return pt.fan_out(pt.add_patterns(weekly_bars(spark, folder)), min_rows=100)


@query("k15_pattern_coverage", "pattern:s hits:i share:d9", with_(WEEKLY, FLAGS, MEMBERS, select="""
       SELECT names.pattern, coalesce(hits, 0) AS hits, coalesce(hits, 0) / (SELECT count(*) FROM bars) AS share
       FROM (SELECT unnest([""" + ", ".join(f"'{p}'" for p in [*PATTERN_NAMES, "none"]) + """]) AS pattern) names
       LEFT JOIN (SELECT member AS pattern, count(*) AS hits FROM members GROUP BY 1) USING (pattern)"""))
def coverage(spark, folder):
    return pt.coverage(pt.add_patterns(weekly_bars(spark, folder)))


@query("k16_blind_side", "member:s side:i hits:i", with_(WEEKLY, FLAGS, MEMBERS, select="""
       SELECT member, CASE WHEN regexp_matches(member, 'bearish|shooting_star|evening_star|dark_cloud_cover') THEN -1 ELSE 1 END AS side,
              count(*) AS hits FROM members GROUP BY 1, 2"""))
def blind_side(spark, folder):
    long = pt.fan_out(pt.add_patterns(weekly_bars(spark, folder)))
    return long.groupBy("member", pt.blind_side(F.col("member")).alias("side")).agg(F.count(F.lit(1)).alias("hits"))


# ---------------------------------------------------------------- base features
@query("b1_b2_returns", "symbol:i datetime:t " + rounded("ret_1 ret_2 ret_3 ret_5 ret_10 log_ret_1"),
       with_(WEEKLY, RETURNS, select="SELECT * FROM rets"))
def returns(spark, folder):
    return bf.add_returns(weekly_bars(spark, folder))


SHAPE = """
shape AS (
  SELECT *, (high - low) / close AS hl_spread, (close - open) / open AS co_spread,
         (open - lag(close) OVER w) / lag(close) OVER w AS gap,
         close * nullif(volume, 0) AS dollar_volume, ln(1 + greatest(close * nullif(volume, 0), 0)) AS log_dollar_volume
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY datetime))"""


@query("b3_b4_shape_value", "symbol:i datetime:t " + rounded("hl_spread co_spread gap log_dollar_volume") + " dollar_volume:d2",
       with_(WEEKLY, RETURNS, SHAPE, select="SELECT * FROM shape"))
def shape(spark, folder):
    return bf.add_shape(bf.add_returns(weekly_bars(spark, folder)))


def _rolling_sql():
    out = []
    for n in bf.ROLL_BARS:
        f = f"(PARTITION BY symbol ORDER BY datetime ROWS {n - 1} PRECEDING)"
        half, third = max(5, n // 2), max(5, n // 3)
        out.append(f"CASE WHEN count(ret_1) OVER {f} >= {half} THEN stddev_samp(ret_1) OVER {f} END AS volatility_{n}")
        for col, name in (("close", "z_close"), ("nullif(volume, 0)", "z_volume")):
            out.append(
                f"CASE WHEN count({col}) OVER {f} >= {third} THEN ({col} - avg({col}) OVER {f})"
                f" / nullif(stddev_samp({col}) OVER {f}, 0) END AS {name}_{n}"
            )
        out.append(f"CASE WHEN count(dollar_volume) OVER {f} >= {third} THEN avg(dollar_volume) OVER {f} END AS dollar_volume_mean_{n}")
    return "SELECT symbol, datetime, " + ",\n".join(out) + " FROM shape"


ROLL_NAMES = " ".join(f"volatility_{n} z_close_{n} z_volume_{n}" for n in bf.ROLL_BARS)
ROLL_MEANS = " ".join(f"dollar_volume_mean_{n}" for n in bf.ROLL_BARS)


@query("b5_b7_rolling", f"symbol:i datetime:t {rounded(ROLL_NAMES, 'd5')} {rounded(ROLL_MEANS, 'd2')}",
       with_(WEEKLY, RETURNS, SHAPE, select=_rolling_sql()))
def rolling(spark, folder):
    return bf.add_rolling(bf.add_shape(bf.add_returns(weekly_bars(spark, folder))))


W20 = "(PARTITION BY symbol ORDER BY datetime ROWS 19 PRECEDING)"


@query("b8_b9_range_liquidity", "symbol:i datetime:t range_to_atr20_proxy:d amihud_illiquidity_20:d9",
       with_(WEEKLY, RETURNS, SHAPE, select=f"""SELECT symbol, datetime,
       CASE WHEN count(high) OVER {W20} >= 5 THEN (high - low) / nullif(avg(high - low) OVER {W20}, 0) END AS range_to_atr20_proxy,
       CASE WHEN count(abs(ret_1) / dollar_volume) OVER {W20} >= 5 THEN avg(abs(ret_1) / dollar_volume) OVER {W20} END AS amihud_illiquidity_20
       FROM shape"""))
def range_liquidity(spark, folder):
    return bf.add_range_liquidity(bf.add_shape(bf.add_returns(weekly_bars(spark, folder))))


@query("b10_streaks", "symbol:i datetime:t up_streak:i down_streak:i", with_(WEEKLY, RETURNS, """
runs AS (SELECT *, sum(CASE WHEN ret_1 <= 0 THEN 1 ELSE 0 END) OVER w AS u, sum(CASE WHEN ret_1 >= 0 THEN 1 ELSE 0 END) OVER w AS d
         FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING))""", select="""
SELECT symbol, datetime,
       sum(CASE WHEN ret_1 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, u ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS up_streak,
       sum(CASE WHEN ret_1 < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, d ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS down_streak
FROM runs"""))
def streaks(spark, folder):
    return bf.add_streaks(bf.add_returns(weekly_bars(spark, folder)))


@query("b12_volume_delta", "symbol:i datetime:t delta_volume:d", with_(WEEKLY, select="""
       SELECT symbol, datetime, volume / lag(volume) OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS delta_volume FROM bars"""))
def volume_delta(spark, folder):
    return bf.add_volume_deltas(weekly_bars(spark, folder))


# ---------------------------------------------------------------- labels
@query("l1_future_return", "symbol:i datetime:t future_return:d", with_(WEEKLY, FUTURE, select="SELECT * FROM labels"))
def future_return(spark, folder):
    return lb.add_future_return(weekly_bars(spark, folder))


@query("l2_market_excess", "symbol:i datetime:t " + rounded("future_return future_market_return future_excess_return"),
       with_(WEEKLY, FUTURE, select="SELECT * FROM labels"))
def market_excess(spark, folder):
    return lb.add_market_labels(lb.add_future_return(weekly_bars(spark, folder)))


@query("l3_rank_pct", "symbol:i datetime:t future_return:d future_rank_pct:d",
       with_(WEEKLY, FUTURE, select="SELECT * FROM labels"))
def rank_pct(spark, folder):
    return lb.add_rank_label(lb.add_future_return(weekly_bars(spark, folder)))


@query("l4_directions", "symbol:i datetime:t absolute:x cross_sectional:x excess:x", with_(WEEKLY, FUTURE, select="""
       SELECT symbol, datetime, CAST(future_return > 0.01 AS INT) AS absolute, CAST(future_rank_pct > 0.5 AS INT) AS cross_sectional,
              CAST(future_excess_return > 0 AS INT) AS excess FROM labels"""))
def directions(spark, folder):
    frame = lb.add_labels(weekly_bars(spark, folder))
    return frame.select(
        "symbol",
        "datetime",
        lb.direction("absolute", 0.01).alias("absolute"),
        lb.direction("cross_sectional", 7.0).alias("cross_sectional"),
        lb.direction("anything else").alias("excess"),
    )


@query("l5_drop_unlabeled", "symbol:i datetime:t future_return:d",
       with_(WEEKLY, FUTURE, select="SELECT * FROM labels WHERE future_return IS NOT NULL"))
def drop_unlabeled(spark, folder):
    return lb.drop_unlabeled(lb.add_labels(weekly_bars(spark, folder)))


CUT = """
dates AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT datetime FROM bars)),
cut AS (SELECT datetime AS cutoff FROM dates WHERE i = greatest(1, least(CAST(floor(n * 0.8) AS BIGINT), n - 1)))"""


@query("l6_chronological_split", "symbol:i datetime:t split:s",
       with_(WEEKLY, CUT, select="SELECT symbol, datetime, CASE WHEN datetime >= cutoff THEN 'test' ELSE 'train' END AS split FROM bars, cut"))
def chronological_split(spark, folder):
    return lb.chronological_split(weekly_bars(spark, folder))


@query("l7_split_at_date", "symbol:i datetime:t split:s",
       with_(WEEKLY, select="SELECT symbol, datetime, CASE WHEN datetime >= TIMESTAMP '2000-06-01' THEN 'test' ELSE 'train' END AS split FROM bars"))
def split_at(spark, folder):
    return lb.split_at(weekly_bars(spark, folder), "2000-06-01")


@query("l8_label_end", "symbol:i datetime:t label_end_datetime:t",
       with_(WEEKLY, select="SELECT symbol, datetime, lead(datetime, 3) OVER (PARTITION BY symbol ORDER BY datetime) AS label_end_datetime FROM bars"))
def label_end(spark, folder):
    return lb.add_label_end(weekly_bars(spark, folder), 3)


@query("l9_l10_purge_embargo", "symbol:i datetime:t label_end_datetime:t",
       with_(WEEKLY, select="""SELECT * FROM (SELECT symbol, datetime, lead(datetime, 2) OVER (PARTITION BY symbol ORDER BY datetime) AS label_end_datetime FROM bars)
       WHERE datetime < TIMESTAMP '2000-06-01' AND label_end_datetime < TIMESTAMP '2000-06-01' + INTERVAL 3 DAY"""))
def purge_embargo(spark, folder):
    frame = lb.add_label_end(weekly_bars(spark, folder), 2)
    cut = ts("2000-06-01")
    return lb.purge(frame.where(F.col("datetime") < cut), lb.embargoed(cut, "1d", 3))


WINDOWS = """
win AS (
  SELECT row_number() OVER (ORDER BY test_start) - 1 AS window_no, test_start - INTERVAL 730 DAY AS train_start,
         test_start, test_start + INTERVAL 365 DAY AS test_end
  FROM (SELECT hi, unnest(generate_series(lo, hi, INTERVAL 365 DAY)) AS test_start FROM (SELECT min(datetime) + INTERVAL 730 DAY AS lo, max(datetime) AS hi FROM bars))
  WHERE test_start < hi),
ends AS (SELECT symbol, datetime, lead(datetime) OVER (PARTITION BY symbol ORDER BY datetime) AS label_end FROM bars)"""


@query("l11_walk_forward_windows", "window_no:i train_start:t test_start:t test_end:t",
       with_(WEEKLY, WINDOWS, select="SELECT * FROM win"))
def walk_windows(spark, folder):
    return lb.walk_forward_windows(weekly_bars(spark, folder), 730, 365, 100)


@query("j8_window_assignment", "window_no:i role:s rows:i", with_(WEEKLY, WINDOWS, select="""
SELECT window_no, role, count(*) AS rows FROM (
  SELECT window_no, CASE WHEN datetime >= test_start + INTERVAL 2 DAY AND datetime < test_end AND label_end < test_end THEN 'test'
                         WHEN datetime >= train_start AND datetime < test_start AND label_end < test_start + INTERVAL 2 DAY THEN 'train' END AS role
  FROM ends, win) WHERE role IS NOT NULL GROUP BY 1, 2"""))
def window_assignment(spark, folder):
    frame = lb.add_label_end(weekly_bars(spark, folder))
    windows = lb.walk_forward_windows(frame, 730, 365, 365)
    rows = lb.assign_windows(frame.select("symbol", "datetime", "label_end_datetime"), windows, "1d", 2)
    return rows.groupBy("window_no", "role").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- signals
SCORE = "1 / (1 + exp(-20 * ret_1))"

SIGNALS_SQL = (
    REALIZED.format(source="rets").strip()
    + f""",
scored AS (
  SELECT *, {SCORE} AS pred_prob_up FROM realized WHERE ret_1 IS NOT NULL),
trades AS (
  SELECT *, position * realized_return - 5.0 / 10000 - CASE WHEN position < 0 THEN 0.5 / 10000 ELSE 0 END AS strategy_return
  FROM (SELECT *, CASE WHEN pred_prob_up <= 0.45 THEN -1 WHEN pred_prob_up >= 0.55 THEN 1 ELSE 0 END AS position FROM scored)
  WHERE position <> 0 AND abs(realized_return) <= 3)"""
)


def scored_bars(spark, folder):
    """Weekly bars with a deterministic probability until a trained model supplies one."""
    frame = sg.add_realized_return(bf.add_returns(weekly_bars(spark, folder)))
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("ret_1") * -20.0))
    return frame.withColumn("pred_prob_up", prob).where(F.col("ret_1").isNotNull())


def signal_trades(spark, folder, costs=sg.Costs()):
    pos = sg.position(F.col("pred_prob_up"), F.lit(sg.DEFAULT_LONG), F.lit(sg.DEFAULT_SHORT))
    frame = scored_bars(spark, folder).withColumn("position", pos).where(F.col("position") != 0)
    frame = sg.drop_extreme(frame.where(F.col("realized_return").isNotNull()))
    return frame.withColumn("strategy_return", costs.net(F.col("position"), F.col("realized_return")))


def blind_trades(spark, folder):
    frame = sg.add_realized_return(pt.add_patterns(weekly_bars(spark, folder)))
    return sg.blind_trades(pt.fan_out(frame), sg.Costs())


@query("r1_realized_return", "symbol:i datetime:t next_bar:d delayed:d", with_(WEEKLY, select="""
       SELECT symbol, datetime, lead(close) OVER w / close - 1 AS next_bar, lead(close, 6) OVER w / lead(close) OVER w - 1 AS delayed
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY datetime)"""))
def realized_return(spark, folder):
    bars = weekly_bars(spark, folder)
    both = sg.add_realized_return(bars).withColumnRenamed("realized_return", "next_bar")
    return sg.add_realized_return(both, horizon=5, latency=1).withColumnRenamed("realized_return", "delayed")


@query("r2_extreme_filter", "symbol:i datetime:t realized_return:d",
       with_(WEEKLY, RETURNS, REALIZED.format(source="rets"), select="SELECT * FROM realized WHERE abs(realized_return) <= 3"))
def extreme_filter(spark, folder):
    return sg.drop_extreme(sg.add_realized_return(weekly_bars(spark, folder)))


@query("r3_r5_signal_trades", "symbol:i datetime:t pred_prob_up:d position:i realized_return:d strategy_return:d",
       with_(WEEKLY, RETURNS, SIGNALS_SQL, select="SELECT * FROM trades"))
def trades(spark, folder):
    return signal_trades(spark, folder)


@query("r4_threshold_resolution", "s_suppkey:i long_at:d short_at:d", """
       SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 0.6 END, CASE WHEN s_suppkey % 2 = 0 THEN 0.58 END, 0.55) AS long_at,
              coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 0.4 END, CASE WHEN s_suppkey % 2 = 0 THEN 0.42 END, 0.45) AS short_at FROM supplier""")
def threshold_resolution(spark, folder):
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        "s_suppkey",
        sg.resolve_threshold(F.when(key % 3 == 0, 0.6), F.when(key % 2 == 0, 0.58), sg.DEFAULT_LONG).alias("long_at"),
        sg.resolve_threshold(F.when(key % 3 == 0, 0.4), F.when(key % 2 == 0, 0.42), sg.DEFAULT_SHORT).alias("short_at"),
    )


BLIND_PERIODS = "periods AS (SELECT member, datetime, avg(strategy_return) AS period_return FROM blind GROUP BY 1, 2)"
BLIND_PARTS = (WEEKLY, FLAGS, MEMBERS, REALIZED.format(source="bars"), BLIND, BLIND_PERIODS)


@query("flagship_blind_bearish_engulfing", "datetime:t period_return:d", with_(*BLIND_PARTS, select="""
       SELECT datetime, period_return FROM periods WHERE member = 'bearish_engulfing'"""))
def flagship(spark, folder):
    frame = sg.add_realized_return(pt.add_patterns(weekly_bars(spark, folder)))
    hits = pt.pattern_hits(frame, "bearish_engulfing").withColumn("member", F.lit("bearish_engulfing"))
    return sg.period_returns(sg.blind_trades(hits, sg.Costs()), [])


@query("r6_r15_blind_period_returns", "member:s datetime:t period_return:d", with_(*BLIND_PARTS, select="SELECT * FROM periods"))
def blind_periods(spark, folder):
    return sg.period_returns(blind_trades(spark, folder), ["member"])


METRIC_COLS = "cumulative_return sharpe sortino max_drawdown win_rate_period annualized_return annualized_volatility"


@query("r7_r13_summary", "member:s trades:i " + rounded("win_rate_trade avg_trade_return profit_factor " + METRIC_COLS)
       + " start_datetime:t end_datetime:t",
       with_(*BLIND_PARTS, metrics_sql("periods", "member"),
             f"t AS (SELECT member, {TRADE_METRICS} FROM blind GROUP BY member)",
             select="SELECT * FROM t JOIN periods_metrics USING (member)"))
def summary(spark, folder):
    return sg.summary(blind_trades(spark, folder), ["member"])


@query("r14_equity_curve", "member:s datetime:t period_return:d cumulative_return:d equity_value:d2",
       with_(*BLIND_PARTS, metrics_sql("periods", "member"), select="""
       SELECT member, datetime, greatest(period_return, -0.999999999) AS period_return, growth - 1 AS cumulative_return,
              growth * 10000 AS equity_value FROM periods_growth"""))
def equity_curve(spark, folder):
    return sg.equity_curve(sg.period_returns(blind_trades(spark, folder), ["member"]), ["member"])


@query("r16_universe_baseline", "datetime:t period_return:d",
       with_(WEEKLY, REALIZED.format(source="bars"), select="SELECT datetime, avg(realized_return) AS period_return FROM realized WHERE abs(realized_return) <= 3 GROUP BY 1"))
def universe(spark, folder):
    return sg.universe_baseline(sg.add_realized_return(weekly_bars(spark, folder)))


@query("r17_dedupe_windows", "symbol:i datetime:t window_start:t pred_prob_up:d", with_(WEEKLY, RETURNS, f"""
w AS (SELECT symbol, datetime, {SCORE} AS pred_prob_up, TIMESTAMP '1997-01-01' AS window_start FROM rets WHERE ret_1 IS NOT NULL AND datetime < TIMESTAMP '1999-01-01'
      UNION ALL SELECT symbol, datetime, {SCORE} * 0.9 AS pred_prob_up, TIMESTAMP '1998-01-01' AS window_start FROM rets WHERE ret_1 IS NOT NULL AND datetime >= TIMESTAMP '1998-01-01'
      UNION ALL SELECT symbol, datetime, {SCORE} * 0.8 AS pred_prob_up, TIMESTAMP '1998-01-01' AS window_start FROM rets WHERE ret_1 IS NOT NULL AND datetime >= TIMESTAMP '1998-01-01')""",
       select="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, datetime ORDER BY window_start, abs(pred_prob_up - 0.5) DESC, pred_prob_up) AS rn FROM w) WHERE rn = 1"""))
def dedupe_windows(spark, folder):
    # written once: three branches of windows and sorts beside each other would share one task's memory
    base = settle(scored_bars(spark, folder).select("symbol", "datetime", "pred_prob_up"))
    early = base.where(F.col("datetime") < ts("1999-01-01")).withColumn("window_start", ts("1997-01-01"))
    late = base.where(F.col("datetime") >= ts("1998-01-01")).withColumn("window_start", ts("1998-01-01"))
    p = F.col("pred_prob_up")
    every = early.unionByName(late.withColumn("pred_prob_up", p * 0.9)).unionByName(late.withColumn("pred_prob_up", p * 0.8))
    return sg.dedupe_windows(every)


OOS_MODELS = """SELECT 'dated' AS model_file, 'doji' AS pattern, TIMESTAMP '1999-01-01' AS train_end, TIMESTAMP '1999-03-01' AS test_start
           UNION ALL SELECT 'train_only', 'none', TIMESTAMP '2000-01-01', CAST(NULL AS TIMESTAMP)
           UNION ALL SELECT 'undated', 'doji', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP)
           UNION ALL SELECT 'beyond', 'hammer', TIMESTAMP '2030-01-01', CAST(NULL AS TIMESTAMP)"""


@query("r18_out_of_sample_pool", "model_file:s rows:i first_row:t last_row:t", with_(WEEKLY, FLAGS, MEMBERS, CUT, f"""
models AS ({OOS_MODELS}),
spans AS (SELECT max(datetime) FILTER (WHERE datetime < cutoff) AS last_train, max(datetime) AS last_date FROM bars, cut),
starts AS (SELECT model_file, pattern, greatest(coalesce(train_end, last_train), test_start) + INTERVAL 7 DAY AS start, last_date FROM models, spans)""", select="""
SELECT model_file, count(*) AS rows, min(datetime) AS first_row, max(datetime) AS last_row
FROM members m JOIN starts s ON s.pattern = m.member, cut
WHERE datetime >= CASE WHEN start <= last_date THEN start ELSE cutoff END GROUP BY 1"""))
def oos_pool(spark, folder):
    split = lb.chronological_split(pt.add_patterns(weekly_bars(spark, folder)))
    hits = pt.fan_out(split).drop("pattern")
    pool = sg.out_of_sample(hits, spark.sql(OOS_MODELS), "1d", 7, split)
    return pool.groupBy("model_file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first_row"), F.max("datetime").alias("last_row")
    )


@query("r19_combined_curve", "datetime:t period_return:d cumulative_return:d equity_value:d2",
       with_(*BLIND_PARTS, """mix AS (SELECT 'combined' AS k, datetime, avg(period_return) AS period_return FROM periods
             WHERE member IN ('doji', 'hammer', 'bearish_engulfing') GROUP BY 2)""", metrics_sql("mix", "k"), select="""
       SELECT datetime, greatest(period_return, -0.999999999) AS period_return, growth - 1 AS cumulative_return, growth * 10000 AS equity_value FROM mix_growth"""))
def combined_curve(spark, folder):
    periods = sg.period_returns(blind_trades(spark, folder), ["member"])
    return sg.combine_curves(periods, ["doji", "hammer", "bearish_engulfing"], "member")


@query("r20_curve_pivot", "datetime:t doji:d2 hammer:d2 none:d2", with_(*BLIND_PARTS, metrics_sql("periods", "member"), select="""
       SELECT datetime, max(growth * 10000) FILTER (WHERE member = 'doji') AS doji, max(growth * 10000) FILTER (WHERE member = 'hammer') AS hammer,
              max(growth * 10000) FILTER (WHERE member = 'none') AS none FROM periods_growth WHERE member IN ('doji', 'hammer', 'none') GROUP BY 1"""))
def curve_pivot(spark, folder):
    wanted = ["doji", "hammer", "none"]
    periods = sg.period_returns(blind_trades(spark, folder), ["member"]).where(F.col("member").isin(wanted))
    return sg.curve_pivot(sg.equity_curve(periods, ["member"]), "member", wanted)
