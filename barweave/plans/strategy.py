"""Queries: portfolios, spreads, regimes, threshold searches, reports and valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions.tables import settle
from barweave.operators import (
    base_features as bf, context as cx, labels as lb, patterns as pt, portfolio as pf, reports as rp, signals as sg, spreads as sp,
    thresholds as th, valuation as va,
)
from barweave.plans.context import BETAS, MARKET, guard
from barweave.plans.core import BLIND_PARTS, METRIC_COLS, SCORE, blind_trades
from barweave.plans.registry import query, rounded
from barweave.plans.sqlparts import (
    BLIND, FLAGS, FUTURE, MEMBERS, REALIZED, RETURNS, TRADE_METRICS, WEEKLY, metrics_sql, with_,
)
from barweave.sources.demo import benchmark_bars, quotes, statements, table, weekly_bars

COSTS = sg.Costs()


# ---------------------------------------------------------------- the signal table
def probability():
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("ret_1") * -20.0))


def scored_members(spark, folder, bars=None):
    """Every (bar, pattern it shows) with a deterministic probability, realized return, volatility, beta and size.

    The features and the market they are held against read one written table of bars.
    """
    frame = sg.add_realized_return(pt.add_patterns(settle(weekly_bars(spark, folder)) if bars is None else bars))
    frame = bf.add_rolling(bf.add_shape(bf.add_returns(frame)), (20,))
    frame = cx.add_betas(cx.add_market_context(frame))
    firms = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("market_cap"))
    long = pt.fan_out(frame.where(F.col("ret_1").isNotNull())).join(firms, "symbol", "left")
    return long.select(
        "symbol",
        "datetime",
        probability().alias("pred_prob_up"),
        "realized_return",
        F.col("member").alias("pattern"),
        F.concat(F.lit("model_"), F.col("symbol") % 6).alias("model_file"),
        "volatility_20",
        "beta_63",
        "market_cap",
    ).withColumn("score", F.col("pred_prob_up") - 0.5)


def signals(spark, folder):
    """The active signals, written once: every report below reads them several times."""
    long = scored_members(spark, folder).where(F.col("realized_return").isNotNull())
    p = F.col("pred_prob_up")
    return settle(sg.drop_extreme(long.where((p >= sg.DEFAULT_LONG) | (p <= sg.DEFAULT_SHORT))))


SIGNAL_PARTS = (
    WEEKLY, FLAGS, MEMBERS, RETURNS, MARKET, BETAS,
    f"""
scored_members AS (
  SELECT m.symbol, m.datetime, {SCORE} AS pred_prob_up, {SCORE} - 0.5 AS score, m.member AS pattern, 'model_' || (m.symbol % 6) AS model_file,
         v.volatility_20, v.beta_63, v.realized_return, s.s_acctbal AS market_cap
  FROM members m
  JOIN (SELECT symbol, datetime, ret_1, beta_63, {guard("stddev_samp(ret_1)", "ret_1", 20, 10)} AS volatility_20,
               lead(close) OVER (PARTITION BY symbol ORDER BY datetime) / close - 1 AS realized_return FROM betas) v USING (symbol, datetime)
  LEFT JOIN supplier s ON s.s_suppkey = m.symbol
  WHERE ret_1 IS NOT NULL),
signals AS (SELECT * FROM scored_members WHERE (pred_prob_up >= 0.55 OR pred_prob_up <= 0.45) AND abs(realized_return) <= 3)""",
)

PICKED = """
floored AS (SELECT * FROM signals WHERE abs(score) >= 0.08),
thinned AS (SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY datetime) - 1 AS bar_index FROM floored) WHERE bar_index % 2 = 0),
collapsed AS (SELECT datetime, symbol, avg(score) AS score, avg(realized_return) AS realized_return, avg(volatility_20) AS volatility_20
              FROM thinned GROUP BY 1, 2),
picked AS (SELECT * FROM (SELECT *, CAST(sign(score) AS INT) AS side, row_number() OVER (PARTITION BY datetime, sign(score) ORDER BY abs(score) DESC, symbol) AS rk
           FROM collapsed WHERE score <> 0) WHERE rk <= 5)"""

SIZED = """
raws AS (SELECT *, CASE WHEN volatility_20 IS NULL OR volatility_20 = 0 THEN 0 ELSE greatest(abs(score), 1e-6) / least(greatest(abs(volatility_20), 0.005), 2) END AS raw,
                CASE WHEN min(side) OVER d <> max(side) OVER d THEN 0.5 ELSE 1.0 END AS budget
         FROM picked WINDOW d AS (PARTITION BY datetime)),
w1 AS (SELECT *, least(0.35, budget * CASE WHEN sum(raw) OVER s > 0 THEN raw / sum(raw) OVER s ELSE 1.0 / count(*) OVER s END) AS w
       FROM raws WINDOW s AS (PARTITION BY datetime, side)),
w2 AS (SELECT * REPLACE (CASE WHEN sum(w) OVER s > budget THEN budget * w / sum(w) OVER s ELSE w END AS w) FROM w1 WINDOW s AS (PARTITION BY datetime, side)),
w3 AS (SELECT *, side * CASE WHEN sum(w) OVER d > 1 THEN w / sum(w) OVER d ELSE w END AS weight FROM w2 WINDOW d AS (PARTITION BY datetime)),
pf_trades AS (SELECT *, weight * realized_return - abs(weight) * 5.0 / 10000 - CASE WHEN weight < 0 THEN abs(weight) * 0.5 / 10000 ELSE 0 END AS strategy_return FROM w3)"""


def picked(spark, folder):
    chosen = pf.thin_rebalances(pf.score_floor(signals(spark, folder), 0.08), 2)
    return pf.pick_sides(pf.collapse(chosen), 5)


@query("g1_g4_selection", "datetime:t symbol:i side:i score:d realized_return:d volatility_20:d",
       with_(*SIGNAL_PARTS, PICKED, select="SELECT * FROM picked"))
def selection(spark, folder):
    return picked(spark, folder)


@query("g5_g6_weights", "datetime:t symbol:i weight:d trade_return:d",
       with_(*SIGNAL_PARTS, PICKED, SIZED, select="SELECT *, strategy_return AS trade_return FROM pf_trades"))
def weights(spark, folder):
    return pf.trade_returns(pf.size_positions(picked(spark, folder)), COSTS)


@query("g7_portfolio_summary", "pattern:s trades:i " + rounded("win_rate_trade avg_trade_return profit_factor " + METRIC_COLS, "d5"),
       with_(*SIGNAL_PARTS, PICKED, SIZED, "pf AS (SELECT 'portfolio_combined' AS pattern, datetime, sum(strategy_return) AS period_return FROM pf_trades GROUP BY 2)",
             metrics_sql("pf", "pattern"), f"t AS (SELECT 'portfolio_combined' AS pattern, {TRADE_METRICS} FROM pf_trades)",
             select="SELECT * FROM t JOIN pf_metrics USING (pattern)"))
def portfolio_summary(spark, folder):
    trades = pf.portfolio_trades(signals(spark, folder), COSTS, min_abs_score=0.08, rebalance_every=2)
    return pf.portfolio_summary(trades)


@query("g8_best_patterns", "pattern:s trades:i objective_score:d5",
       with_(*BLIND_PARTS, metrics_sql("periods", "member"), f"t AS (SELECT member, {TRADE_METRICS} FROM blind GROUP BY member)", select="""
       SELECT member AS pattern, trades, cumulative_return + 0.2 * sharpe - 0.15 * abs(max_drawdown) + 0.2 * win_rate_trade - 0.01 * ln(1 + trades) AS objective_score
       FROM t JOIN periods_metrics USING (member) WHERE trades >= 40 AND win_rate_trade >= 0.3 ORDER BY objective_score DESC LIMIT 4"""))
def best_patterns(spark, folder):
    rows = sg.summary(blind_trades(spark, folder), ["member"]).withColumnRenamed("member", "pattern")
    return pf.best_patterns(rows.withColumn("model_file", F.col("pattern")), 4, 40, 0.3)


@query("g9_min_gap_signals", "symbol:i datetime:t score:d", with_(*SIGNAL_PARTS, """
days AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS b FROM (SELECT DISTINCT datetime FROM signals)),
placed AS (SELECT symbol, datetime, b, row_number() OVER (PARTITION BY symbol ORDER BY b) AS i FROM (SELECT DISTINCT symbol, datetime FROM signals) JOIN days USING (datetime)),
walk AS (
  SELECT symbol, i, b AS kept, true AS ok FROM placed WHERE i = 1
  UNION ALL
  SELECT p.symbol, p.i, CASE WHEN p.b - w.kept > 3 THEN p.b ELSE w.kept END, p.b - w.kept > 3 FROM walk w JOIN placed p ON p.symbol = w.symbol AND p.i = w.i + 1)""",
       rec=True, select="""SELECT s.symbol, s.datetime, s.score FROM signals s JOIN placed p USING (symbol, datetime) JOIN walk w ON w.symbol = p.symbol AND w.i = p.i WHERE w.ok"""))
def min_gap(spark, folder):
    return pf.spaced_signals(signals(spark, folder), 3)


# ---------------------------------------------------------------- spreads and regimes
def component_sql(name: str, column: str) -> str:
    return f"""
{name}_raw AS (
  SELECT datetime, {column} AS component,
         avg(CASE WHEN score >= 0 THEN realized_return - 5.0 / 10000 ELSE -realized_return - 5.0 / 10000 - 0.5 / 10000 END) AS period_return,
         avg(beta_63) AS component_beta_63, avg(ln(1 + greatest(market_cap, 0))) AS size, count(DISTINCT symbol) AS component_signal_count
  FROM signals GROUP BY 1, 2),
{name}_comp AS (
  SELECT *, CASE WHEN count(size) OVER d >= 2 AND stddev_pop(size) OVER d > 0 THEN (size - avg(size) OVER d) / stddev_pop(size) OVER d ELSE 0 END AS component_size_z
  FROM {name}_raw WINDOW d AS (PARTITION BY datetime))"""


def scores_sql(name: str, lb: int) -> str:
    n, mp = max(20, lb), max(5, max(20, lb) // 3)
    f = f"(PARTITION BY component ORDER BY datetime ROWS {n - 1} PRECEDING)"
    past = f"(PARTITION BY component ORDER BY datetime ROWS BETWEEN {lb} PRECEDING AND 1 PRECEDING)"
    both = "CASE WHEN period_return IS NOT NULL THEN 1 END"
    return f"""
{name}_mkt AS (SELECT datetime, avg(period_return) AS mkt FROM {name}_comp GROUP BY 1),
{name}_grid AS (
  SELECT d.datetime, c.component, x.period_return, x.component_size_z, m.mkt
  FROM (SELECT DISTINCT datetime FROM {name}_comp) d CROSS JOIN (SELECT DISTINCT component FROM {name}_comp) c
  LEFT JOIN {name}_comp x USING (datetime, component) LEFT JOIN {name}_mkt m USING (datetime)),
{name}_score AS (
  SELECT datetime, component, period_return, component_size_z,
         CASE WHEN count({both}) OVER {f} >= {mp} THEN covar_samp(period_return, mkt) OVER {f} END
           / nullif(CASE WHEN count(mkt) OVER {f} >= {mp} THEN var_samp(mkt) OVER {f} END, 0) AS beta,
         CASE WHEN period_return IS NOT NULL AND count(period_return) OVER {past} >= {max(8, lb // 3)}
                   AND row_number() OVER (PARTITION BY component ORDER BY datetime) > {lb}
              THEN coalesce(avg(period_return) OVER {past} / nullif(stddev_samp(period_return) OVER {past}, 0), avg(period_return) OVER {past}) END AS score
  FROM {name}_grid)"""


def spread_sql(name: str, lb: int, k: int, cost: float, neutral: bool) -> str:
    pen = (
        "coalesce(0.25 * abs(l.beta - s.beta), 0) + coalesce(0.15 * abs(l.component_size_z - s.component_size_z), 0)" if neutral else "0"
    )
    wl = "0.5"
    if neutral:
        b = "coalesce(CASE WHEN abs(lb) + abs(sb) > 1e-9 THEN abs(sb) / (abs(lb) + abs(sb)) END, 0.5)"
        z = "CASE WHEN abs(lz) + abs(sz) > 1e-9 THEN abs(sz) / (abs(lz) + abs(sz)) END"
        wl = f"coalesce(0.5 * ({b} + {z}), {b})"
    return f"""
{name}_rank AS (
  SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, component) AS top, count(*) OVER (PARTITION BY datetime) AS n
  FROM {name}_score WHERE score IS NOT NULL),
{name}_pairs AS (
  SELECT l.datetime, l.component AS long_component, s.component AS short_component, l.score - s.score AS edge, l.score - s.score - ({pen}) AS objective,
         l.period_return AS lr, s.period_return AS sr, l.beta AS lb, s.beta AS sb, l.component_size_z AS lz, s.component_size_z AS sz
  FROM {name}_rank l JOIN {name}_rank s ON l.datetime = s.datetime AND l.component <> s.component
  WHERE l.n >= 2 AND l.top <= {k} AND s.top > s.n - {k} AND l.score - s.score >= 0),
{name}_best AS (
  SELECT * EXCLUDE rk, {wl} AS long_weight FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY objective DESC, long_component, short_component) AS rk FROM {name}_pairs)
  WHERE rk = 1),
{name}_spread AS (
  SELECT *, 1 - long_weight AS short_weight, long_weight * lr - (1 - long_weight) * sr - pair_changed * {cost} / 10000 AS period_return
  FROM (SELECT *, CASE WHEN lag(long_component) OVER (ORDER BY datetime) IS NOT NULL AND (lag(long_component) OVER (ORDER BY datetime) <> long_component
                        OR lag(short_component) OVER (ORDER BY datetime) <> short_component) THEN 1 ELSE 0 END AS pair_changed FROM {name}_best))"""


LB = 30


@query("d1_component_periods", "datetime:t component:s period_return:d component_beta_63:d5 component_size_z:d component_signal_count:i",
       with_(*SIGNAL_PARTS, component_sql("p", "pattern"), select="SELECT * FROM p_comp"))
def component_periods(spark, folder):
    return sp.component_periods(signals(spark, folder), "pattern", COSTS)


@query("d2_d4_grid_scores", "datetime:t component:s period_return:d beta:d5 score:d5",
       with_(*SIGNAL_PARTS, component_sql("p", "pattern"), scores_sql("p", LB), select="SELECT * FROM p_score"))
def grid_scores(spark, folder):
    return sp.spread_table(sp.component_periods(signals(spark, folder), "pattern", COSTS), LB)


@query("d5_d7_j10_spread", "datetime:t long_component:s short_component:s edge:d5 objective:d5 long_weight:d5 short_weight:d5 pair_changed:i period_return:d",
       with_(*SIGNAL_PARTS, component_sql("p", "pattern"), scores_sql("p", LB), spread_sql("p", LB, 2, 4.0, True), select="SELECT * FROM p_spread"))
def spread(spark, folder):
    return sp.relative_strength(signals(spark, folder), "pattern", COSTS, LB, 2, switch_cost_bps=4.0, neutral=True)


@query("d8_vol_target", "datetime:t vol_scale:d5 period_return:d", with_(*SIGNAL_PARTS, component_sql("p", "pattern"), scores_sql("p", LB),
       spread_sql("p", LB, 2, 4.0, False), f"sd AS (SELECT *, {guard('stddev_samp(period_return)', 'period_return', 15, 5, '')} AS s FROM p_spread)",
       "sc AS (SELECT *, coalesce(least(3, greatest(0, 0.10 / sqrt(252.0) / nullif(lag(s) OVER (ORDER BY datetime), 0))), 1) AS f, lag(s) OVER (ORDER BY datetime) AS ls FROM sd)",
       select="SELECT datetime, CASE WHEN ls IS NULL OR ls = 0 THEN 1 ELSE f END AS vol_scale, period_return * CASE WHEN ls IS NULL OR ls = 0 THEN 1 ELSE f END AS period_return FROM sc"))
def vol_target(spark, folder):
    return sp.relative_strength(signals(spark, folder), "pattern", COSTS, LB, 2, switch_cost_bps=4.0, target_vol=0.10)


REGIME = f"""
votes AS (SELECT *, {guard("quantile_cont(market_volatility_20, 0.5)", "market_volatility_20", 252, 20, "")} AS um FROM market),
regimes AS (
  SELECT datetime, CASE
    WHEN (CASE WHEN regime_high_vol_downtrend > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN market_drawdown_63 < -0.08 THEN 1 ELSE 0 END)
       + (CASE WHEN market_volatility_20 > 1.1 * um THEN 1 ELSE 0 END) >= 2 THEN 'risk_off'
    WHEN (CASE WHEN regime_low_vol_uptrend > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN market_return_20 > 0 THEN 1 ELSE 0 END)
       + (CASE WHEN market_volatility_20 < 0.9 * um THEN 1 ELSE 0 END) >= 2 THEN 'risk_on' ELSE 'neutral' END AS regime_state FROM votes)"""


def states(spark, folder):
    return sp.regime_states(cx.market_table(bf.add_returns(weekly_bars(spark, folder))))


@query("d9_regime_states", "datetime:t regime_state:s", with_(WEEKLY, RETURNS, MARKET, REGIME, select="SELECT * FROM regimes"))
def regime_states(spark, folder):
    return states(spark, folder)


SWITCH = """
both_s AS (SELECT coalesce(m.datetime, p.datetime) AS datetime, m.period_return AS mr, p.period_return AS pr
           FROM m_spread m FULL JOIN p_spread p ON m.datetime = p.datetime),
st AS (SELECT b.*, coalesce(last_value(r.regime_state IGNORE NULLS) OVER (ORDER BY b.datetime ROWS UNBOUNDED PRECEDING), 'neutral') AS regime_state
       FROM both_s b LEFT JOIN regimes r ON b.datetime = r.datetime)"""


@query("d10_regime_switch", "datetime:t regime_state:s regime_choice:s period_return:d",
       with_(*SIGNAL_PARTS, REGIME, component_sql("p", "pattern"), scores_sql("p", LB), spread_sql("p", LB, 2, 2.0, False),
             component_sql("m", "model_file"), scores_sql("m", LB), spread_sql("m", LB, 2, 2.0, False), SWITCH, select="""
SELECT * FROM (SELECT datetime, regime_state,
  CASE regime_state WHEN 'risk_off' THEN CASE WHEN pr IS NOT NULL THEN 'pattern' ELSE 'model' END
                    WHEN 'risk_on' THEN CASE WHEN mr IS NOT NULL THEN 'model' ELSE 'pattern' END ELSE 'blend' END AS regime_choice,
  CASE regime_state WHEN 'risk_off' THEN coalesce(pr, mr) WHEN 'risk_on' THEN coalesce(mr, pr) ELSE coalesce((mr + pr) / 2, mr, pr) END AS period_return
  FROM st) WHERE period_return IS NOT NULL"""))
def regime_switch(spark, folder):
    table_ = signals(spark, folder)
    model = sp.relative_strength(table_, "model_file", COSTS, LB, 2)
    pattern = sp.relative_strength(table_, "pattern", COSTS, LB, 2)
    return sp.regime_switch(model, pattern, states(spark, folder))


@query("d11_spread_summary", "strategy:s periods:i spread_switches:i spread_components_used:i " + rounded(METRIC_COLS, "d5"),
       with_(*SIGNAL_PARTS, component_sql("p", "pattern"), scores_sql("p", LB), spread_sql("p", LB, 2, 2.0, False),
             "sp AS (SELECT 'spread_pattern_vs_pattern' AS strategy, * FROM p_spread)", metrics_sql("sp", "strategy"), select="""
       SELECT m.*, (SELECT sum(pair_changed) FROM sp) AS spread_switches,
              (SELECT count(DISTINCT c) FROM (SELECT long_component AS c FROM sp UNION ALL SELECT short_component FROM sp)) AS spread_components_used FROM sp_metrics m"""))
def spread_summary(spark, folder):
    return sp.spread_summary(sp.relative_strength(signals(spark, folder), "pattern", COSTS, LB, 2), "spread_pattern_vs_pattern")


# ---------------------------------------------------------------- thresholds
def tie(x):
    """Twin of the tie-safe ordering: equal up to the last bits counts as equal."""
    return f"round(sign({x}) * ln(1 + abs({x})), 10)"


def grid_values(name, values):
    return f"{name} AS (SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {name[0]})"


def pair_sql(value: str, source: str, cost: str, gap: float, borrow: str = "0.5 / 10000") -> str:
    return f"""
pairs AS (SELECT l AS long_threshold, s AS short_threshold FROM longs, shorts WHERE l > s AND l - s >= {gap} - 1e-12),
hits AS (
  SELECT pattern, long_threshold, short_threshold, datetime,
         CASE WHEN pred_prob_up >= long_threshold THEN {value} - {cost} ELSE -{value} - {cost} - {borrow} END AS net,
         CASE WHEN pred_prob_up >= long_threshold THEN 1 ELSE 0 END AS is_long
  FROM {source} JOIN pairs ON pred_prob_up >= long_threshold OR pred_prob_up <= short_threshold WHERE {value} IS NOT NULL),
pp AS (SELECT pattern, long_threshold, short_threshold, datetime, avg(net) AS period_return FROM hits GROUP BY ALL),
nn AS (SELECT pattern, long_threshold, short_threshold, count(*) AS trades, sum(is_long) AS n_long FROM hits GROUP BY ALL)"""


O1_ROWS = """
val AS (SELECT m.pattern, m.datetime, m.pred_prob_up, f.future_excess_return FROM scored_members m JOIN labels f USING (symbol, datetime))"""


@query("o1_validation_thresholds", "pattern:s long_threshold:d short_threshold:d objective:d5 trades:i",
       with_(*SIGNAL_PARTS, FUTURE, O1_ROWS, grid_values("longs", th.LONG_GRID), grid_values("shorts", th.SHORT_GRID),
             pair_sql("future_excess_return", "val", "5.0 / 10000", 0.0, "0"), metrics_sql("pp", "pattern, long_threshold, short_threshold"), """
obj AS (
  SELECT m.pattern, long_threshold, short_threshold, trades,
         cumulative_return + 0.2 * sharpe + 0.1 * sortino + 0.1 * win_rate_period - 0.12 * abs(max_drawdown)
         - 0.55 * abs(2 * n_long - trades) / trades - 0.01 * ln(1 + trades) AS objective
  FROM pp_metrics m JOIN nn USING (pattern, long_threshold, short_threshold)
  WHERE trades >= 20 AND n_long >= 5 AND trades - n_long >= 5)""", select=f"""
SELECT p.pattern, coalesce(long_threshold, 0.55) AS long_threshold, coalesce(short_threshold, 0.45) AS short_threshold,
       coalesce(objective, 0) AS objective, coalesce(trades, 0) AS trades
FROM (SELECT DISTINCT pattern FROM val) p LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY {tie('objective')} DESC, long_threshold, short_threshold) AS rk FROM obj) WHERE rk = 1) b
  ON p.pattern = b.pattern"""))
def validation_thresholds(spark, folder):
    bars = settle(weekly_bars(spark, folder))
    labels = lb.add_market_labels(lb.add_future_return(bars)).select("symbol", "datetime", "future_excess_return")
    rows = scored_members(spark, folder, bars).select("symbol", "datetime", "pattern", "pred_prob_up").join(labels, ["symbol", "datetime"])
    return th.optimize_validation(rows, ["pattern"], COSTS)


LONGS2 = th.local_grid(th.WIDE_LONG_GRID, 0.55, 0.5, 0.95)
SHORTS2 = th.local_grid(th.WIDE_SHORT_GRID, 0.45, 0.05, 0.5)


@query("o2_out_of_sample_thresholds", "pattern:s long_threshold:d short_threshold:d trades:i cumulative_return:d5 improvement_cumulative_return:d5",
       with_(*SIGNAL_PARTS, "oos AS (SELECT * FROM scored_members WHERE abs(realized_return) <= 3.0 AND datetime >= TIMESTAMP '2000-06-01')",
             grid_values("longs", LONGS2), grid_values("shorts", SHORTS2), pair_sql("realized_return", "oos", "5.0 / 10000", 0.03),
             metrics_sql("pp", "pattern, long_threshold, short_threshold"),
             "cand AS (SELECT * FROM pp_metrics JOIN nn USING (pattern, long_threshold, short_threshold) WHERE trades >= 20)", select=f"""
SELECT pattern, long_threshold, short_threshold, trades, cumulative_return,
       cumulative_return - before AS improvement_cumulative_return
FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY {tie('cumulative_return')} DESC, {tie('annualized_return')} DESC, {tie('sharpe')} DESC, {tie('sortino')} DESC,
                                   {tie('-abs(max_drawdown)')} DESC, win_rate_period DESC, trades DESC, long_threshold, short_threshold) AS rk,
             max(cumulative_return) FILTER (WHERE abs(long_threshold - 0.55) < 1e-9 AND abs(short_threshold - 0.45) < 1e-9) OVER (PARTITION BY pattern) AS before
      FROM cand) WHERE rk = 1"""))
def oos_thresholds(spark, folder):
    late = scored_members(spark, folder).where(F.col("datetime") >= F.lit("2000-06-01").cast("timestamp"))
    rows = sg.drop_extreme(late, 3.0)
    return th.optimize_out_of_sample(rows, ["pattern"], COSTS)


@query("o3_recommended_thresholds", "recommended_long_threshold:d recommended_short_threshold:d models_considered:i", """
WITH m AS (SELECT 0.5 + (p_partkey % 11) / 20.0 AS lt, 0.5 - (p_partkey % 9) / 15.0 AS st, greatest(0.45 + (p_size % 10) / 40.0 - 0.5, 0.01) * ln(1 + greatest(p_retailprice, 1)) AS w FROM part)
SELECT least(greatest(sum(lt * w) / sum(w), 0.6), 0.95) AS recommended_long_threshold, least(greatest(sum(st * w) / sum(w), 0.05), 0.4) AS recommended_short_threshold,
       count(*) AS models_considered FROM m WHERE lt BETWEEN 0 AND 1 AND st BETWEEN 0 AND 1""")
def recommended(spark, folder):
    models = table(spark, folder, "part").select(
        (0.5 + (F.col("p_partkey") % 11) / 20.0).alias("tuned_long_threshold"),
        (0.5 - (F.col("p_partkey") % 9) / 15.0).alias("tuned_short_threshold"),
        (0.45 + (F.col("p_size") % 10) / 40.0).alias("roc_auc"),
        F.col("p_retailprice").alias("train_rows"),
    )
    return th.recommend(models)


RESULTS = f"t AS (SELECT member, {TRADE_METRICS} FROM blind GROUP BY member), results AS (SELECT * FROM t JOIN periods_metrics USING (member))"


def results(spark, folder):
    rows = sg.summary(blind_trades(spark, folder), ["member"])
    return rows.withColumnRenamed("member", "pattern").withColumn("model_file", F.concat(F.lit("blind_"), F.col("pattern")))


@query("o4_objective_pick", "pattern:s objective_score:d5", with_(*BLIND_PARTS, metrics_sql("periods", "member"), RESULTS, select="""
       SELECT member AS pattern, cumulative_return + 0.3 * sharpe + 0.2 * win_rate_trade - 0.2 * abs(max_drawdown) - 0.0002 * trades AS objective_score
       FROM results WHERE trades >= 100 ORDER BY objective_score DESC LIMIT 1"""))
def objective_pick(spark, folder):
    return th.pick_objective_row(results(spark, folder), 100)


@query("o5_top_patterns", "pattern:s rank_score:d5", with_(*BLIND_PARTS, metrics_sql("periods", "member"), RESULTS, select="""
       SELECT member AS pattern, cumulative_return + 0.2 * sharpe - 0.0001 * trades AS rank_score FROM results WHERE trades >= 20 ORDER BY rank_score DESC LIMIT 5"""))
def top_patterns(spark, folder):
    return th.top_patterns(results(spark, folder), 5, 20)


@query("j11_threshold_grid", "pattern:s long_threshold:d short_threshold:d trades:i long_trades:i cumulative_return:d5 sharpe:d5",
       with_(*SIGNAL_PARTS, "oos AS (SELECT * FROM scored_members WHERE abs(realized_return) <= 3)", grid_values("longs", (0.55, 0.6, 0.65)),
             grid_values("shorts", (0.35, 0.4, 0.45)), pair_sql("realized_return", "oos", "5.0 / 10000", 0.0),
             metrics_sql("pp", "pattern, long_threshold, short_threshold"), select="""
       SELECT *, n_long AS long_trades FROM pp_metrics JOIN nn USING (pattern, long_threshold, short_threshold)"""))
def threshold_grid(spark, folder):
    rows = sg.drop_extreme(scored_members(spark, folder))
    periods = th.pair_periods(rows, ["pattern"], (0.55, 0.6, 0.65), (0.35, 0.4, 0.45), COSTS, "realized_return")
    table_ = th.pair_metrics(periods, ["pattern"], "1d")
    return table_.withColumn("trades", F.col("long_trades") + F.col("short_trades"))


# ---------------------------------------------------------------- reports
@query("q1_latest_scan", "symbol:i datetime:t pattern:s signal:s prob_up:d confidence:d edge:d",
       with_(*SIGNAL_PARTS, """
latest AS (SELECT * FROM (SELECT *, max(datetime) OVER (PARTITION BY symbol) AS newest FROM scored_members) WHERE datetime = newest),
act AS (SELECT *, CASE WHEN pred_prob_up <= 0.45 THEN 'down' WHEN pred_prob_up >= 0.55 THEN 'up' END AS signal, pred_prob_up AS prob_up FROM latest),
conf AS (SELECT *, CASE signal WHEN 'up' THEN prob_up ELSE 1 - prob_up END AS confidence, CASE signal WHEN 'up' THEN prob_up - 0.55 ELSE 0.45 - prob_up END AS edge
         FROM act WHERE signal IS NOT NULL)""", select="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, edge DESC, pattern DESC) AS rk FROM conf WHERE confidence >= 0.6)
WHERE rk = 1 ORDER BY confidence DESC, edge DESC, symbol LIMIT 40"""))
def latest_scan(spark, folder):
    frame = bf.add_returns(pt.add_patterns(weekly_bars(spark, folder)))
    long = pt.fan_out(rp.latest_rows(frame).where(F.col("ret_1").isNotNull()))
    scored = long.select(
        "symbol",
        "datetime",
        F.col("member").alias("pattern"),
        F.lit("score").alias("model_file"),
        probability().alias("prob_up"),
        F.lit(0.5).alias("model_roc_auc"),
        F.lit(sg.DEFAULT_LONG).alias("long_threshold"),
        F.lit(sg.DEFAULT_SHORT).alias("short_threshold"),
    )
    return rp.scan_signals(scored, 0.6, 40)


@query("q2_regime_snapshot", "regime:s rows:i share:d avg_future_return:d", with_(WEEKLY, RETURNS, MARKET, """
ds AS (SELECT r.*, m.regime_low_vol_uptrend, m.regime_high_vol_downtrend, lead(close) OVER (PARTITION BY symbol ORDER BY r.datetime) / close - 1 AS future_return
       FROM rets r LEFT JOIN market m USING (datetime))""", select="""
SELECT 'regime_low_vol_uptrend' AS regime, count(*) AS rows, count(*) / (SELECT count(*) FROM ds) AS share, avg(future_return) AS avg_future_return
FROM ds WHERE regime_low_vol_uptrend > 0 UNION ALL
SELECT 'regime_high_vol_downtrend', count(*), count(*) / (SELECT count(*) FROM ds), avg(future_return) FROM ds WHERE regime_high_vol_downtrend > 0"""))
def regime_snapshot(spark, folder):
    frame = cx.add_market_context(bf.add_returns(weekly_bars(spark, folder)))
    return rp.regime_snapshot(lb.add_future_return(frame))


@query("q3_top_importance", "pattern:s feature:s importance_abs:d rank:i", """
SELECT * FROM (SELECT p_type AS pattern, p_name || '|' || p_brand AS feature, max(abs(p_retailprice - 1000)) AS importance_abs,
  row_number() OVER (PARTITION BY p_type ORDER BY max(abs(p_retailprice - 1000)) DESC, p_name || '|' || p_brand) AS rank FROM part GROUP BY 1, 2) WHERE rank <= 20""")
def top_importance(spark, folder):
    part = table(spark, folder, "part")
    imp = part.groupBy(F.col("p_type").alias("pattern"), F.concat_ws("|", "p_name", "p_brand").alias("feature")).agg(
        F.max(F.abs(F.col("p_retailprice") - 1000)).alias("importance_abs")
    )
    full = imp.withColumns({"interval": F.lit("1d"), "horizon_bars": F.lit(1), "model_name": F.lit("m")})
    return rp.top_importance(full, 20)


def sweep_sql():
    units = ("week", "month", "quarter")
    parts = "\nUNION ALL\n".join(
        f"""SELECT '{u}|' || symbol AS symbol, p AS datetime, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close, sum(volume) AS volume
        FROM (SELECT *, CAST(date_trunc('{u}', datetime) AS TIMESTAMP) AS p FROM weekly) GROUP BY symbol, p"""
        for u in units
    )
    return WEEKLY.replace("bars AS", "weekly AS"), f"bars AS ({parts})"


SWEEP = (*sweep_sql(), FLAGS, MEMBERS, REALIZED.format(source="bars"), BLIND)


@query("q4_interval_sweep", "interval:s dataset_rows:i best_pattern_return:d5 mean_pattern_return:d5 best_pattern_sharpe:d5",
       with_(*SWEEP, "sw AS (SELECT split_part(symbol, '|', 1) AS interval, member, datetime, avg(strategy_return) AS period_return FROM blind GROUP BY 1, 2, 3)",
             metrics_sql("sw", "interval, member"), select="""
SELECT interval, dataset_rows, max(cumulative_return) AS best_pattern_return, avg(cumulative_return) AS mean_pattern_return, max(sharpe) AS best_pattern_sharpe
FROM sw_metrics JOIN (SELECT split_part(symbol, '|', 1) AS interval, count(*) AS dataset_rows FROM bars GROUP BY 1) USING (interval) GROUP BY 1, 2"""))
def interval_sweep(spark, folder):
    return rp.sweep_intervals(weekly_bars(spark, folder))


MONTHLY = """
monthly AS (SELECT symbol, CAST(last_day(datetime) AS TIMESTAMP) AS datetime, arg_max(close, datetime) AS close FROM bars GROUP BY 1, 2),
monthly_ret AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS ret FROM monthly)"""


@query("q5_month_end", "symbol:i datetime:t close:x ret:d", with_(WEEKLY, MONTHLY, select="SELECT * FROM monthly_ret"))
def month_end(spark, folder):
    return rp.month_end(weekly_bars(spark, folder))


# ---------------------------------------------------------------- valuation
STATEMENTS = """
inc AS (
  SELECT l_suppkey AS symbol, date_trunc('quarter', l_shipdate) AS date, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount) * 0.6) AS gross_profit,
         sum(l_extendedprice * l_tax) AS operating_expenses, sum(l_quantity) AS depreciation, sum(l_extendedprice * (0.3 - l_discount)) AS net_income,
         sum(l_quantity * 5) AS interest_expense, sum(l_extendedprice * 0.4) AS ebitda, sum(l_extendedprice * l_tax * 0.5) AS income_tax,
         sum(l_extendedprice * 0.35) AS pretax_income, sum(l_extendedprice * (0.25 - l_discount)) AS ocf, sum(l_extendedprice * 2) AS total_equity,
         sum(l_extendedprice * 1.5) AS total_liabilities, sum(l_extendedprice * 0.8) AS total_debt, sum(l_quantity * 100) AS cash, sum(l_quantity) AS preferred
  FROM lineitem GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS q, count(*) OVER (PARTITION BY symbol) AS nq FROM inc),
ttm AS (
  SELECT symbol, sum(revenue) FILTER (WHERE q < 4) AS ttm_revenue, sum(gross_profit) FILTER (WHERE q < 4) AS ttm_gross, sum(net_income) FILTER (WHERE q < 4) AS ttm_income,
         sum(interest_expense) FILTER (WHERE q < 4) AS ttm_interest, sum(ebitda - depreciation) FILTER (WHERE q < 4) AS ttm_ebit,
         sum(gross_profit - operating_expenses - depreciation) FILTER (WHERE q < 4) AS ttm_operating, sum(income_tax) FILTER (WHERE q < 4) AS ttm_tax,
         sum(pretax_income) FILTER (WHERE q < 4) AS ttm_pretax, sum(ocf) FILTER (WHERE q < 4) AS ttm_ocf,
         coalesce(sum(revenue) FILTER (WHERE q BETWEEN 4 AND 7), 0) AS prior_revenue, coalesce(sum(gross_profit) FILTER (WHERE q BETWEEN 4 AND 7), 0) AS prior_gross,
         coalesce(sum(gross_profit - operating_expenses - depreciation) FILTER (WHERE q BETWEEN 4 AND 7), 0) AS prior_operating
  FROM q GROUP BY symbol),
yr AS (SELECT l_suppkey AS symbol, date_trunc('year', l_shipdate) AS date, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (0.25 - l_discount)) AS ocf FROM lineitem GROUP BY 1, 2),
yk AS (SELECT *, row_number() OVER w - 1 AS k, lead(revenue) OVER w AS r0, lead(ocf) OVER w AS o0, count(*) OVER (PARTITION BY symbol) AS n
       FROM yr WINDOW w AS (PARTITION BY symbol ORDER BY date DESC)),
ys AS (SELECT *, CASE WHEN n > 10 THEN 10 ELSE n - 1 END AS lim FROM yk),
yv AS (SELECT *, min(CASE WHEN k < lim AND revenue > 0 AND r0 > 0 THEN 1 ELSE 0 END) OVER w AS rv, min(CASE WHEN k < lim AND ocf > 0 AND o0 > 0 THEN 1 ELSE 0 END) OVER w AS ov
       FROM ys WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING)),
growth AS (
  SELECT symbol, coalesce(exp(avg(CASE WHEN rv = 1 THEN ln(revenue / r0) END)) - 1, 0) AS revenue_growth, count(*) FILTER (WHERE rv = 1) AS revenue_years,
         coalesce(exp(avg(CASE WHEN ov = 1 THEN ln(ocf / o0) END)) - 1, 0) AS ocf_growth, count(*) FILTER (WHERE ov = 1) AS ocf_years
  FROM yv GROUP BY symbol)"""

BETA_SQL = """
recent AS (SELECT * FROM bars WHERE datetime >= (SELECT max(datetime) FROM bars) - INTERVAL 1899 DAY),
recent_months AS (SELECT symbol, CAST(last_day(datetime) AS TIMESTAMP) AS datetime, arg_max(close, datetime) AS close FROM recent GROUP BY 1, 2),
recent_ret AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS ret FROM recent_months),
bench AS (SELECT 'B' AS symbol, datetime, avg(close) AS close FROM recent GROUP BY 2),
bm AS (SELECT CAST(last_day(datetime) AS TIMESTAMP) AS datetime, arg_max(close, datetime) AS close FROM bench GROUP BY 1),
br AS (SELECT datetime, close / lag(close) OVER (ORDER BY datetime) - 1 AS b FROM bm),
beta5 AS (
  SELECT symbol, coalesce(beta, 1) AS beta FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN (
    SELECT symbol, CASE WHEN count(*) >= 12 AND var_pop(b) > 1e-12 THEN least(5, greatest(-3, covar_pop(ret, b) / var_pop(b))) ELSE 1 END AS beta
    FROM recent_ret JOIN br USING (datetime) WHERE ret IS NOT NULL AND b IS NOT NULL GROUP BY symbol) USING (symbol))"""


@query("v1_trailing_sums", "symbol:i " + rounded("ttm_revenue ttm_gross ttm_income ttm_interest ttm_ebit ttm_operating ttm_tax ttm_pretax ttm_ocf prior_revenue prior_gross prior_operating", "d2"),
       with_(STATEMENTS, select="SELECT * FROM ttm"))
def trailing_sums(spark, folder):
    s = statements(spark, folder)
    return va.trailing_sums(s["income"], s["cash"])


@query("v2_geometric_growth", "symbol:i revenue_growth:d revenue_years:i ocf_growth:d ocf_years:i", with_(STATEMENTS, select="SELECT * FROM growth"))
def geometric_growth(spark, folder):
    s = statements(spark, folder)
    return va.geometric_growth(s["annual_income"], "revenue", "revenue").join(
        va.geometric_growth(s["annual_cash"], "operating_cashflow", "ocf"), "symbol"
    )


# the same over the whole history
WHOLE_BETA_SQL = BETA_SQL.replace(" WHERE datetime >= (SELECT max(datetime) FROM bars) - INTERVAL 1899 DAY", "")


@query("v3_j6_monthly_beta", "symbol:i beta:d5", with_(WEEKLY, MONTHLY, WHOLE_BETA_SQL, select="SELECT * FROM beta5"))
def monthly_beta(spark, folder):
    return va.monthly_beta(weekly_bars(spark, folder), benchmark_bars(spark, folder), days=None)


VALUES = """
qt AS (
  SELECT s_suppkey AS symbol, s_acctbal * 10000 AS market_cap, (s_suppkey % 50 + 1) * 10000.0 AS shares, p.* EXCLUDE symbol
  FROM supplier JOIN (SELECT symbol, arg_max(close, datetime) AS price, max(high) AS year_high, min(low) AS year_low,
                             avg(close) FILTER (WHERE age <= 50) AS avg_50, avg(close) FILTER (WHERE age <= 200) AS avg_200
                      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS age FROM bars) GROUP BY symbol) p ON p.symbol = s_suppkey),
v0 AS (
  SELECT qt.*, t.* EXCLUDE symbol, g.* EXCLUDE symbol, b.beta, l.total_equity, l.total_liabilities, l.total_debt, l.cash, l.preferred, CAST(l.date AS TIMESTAMP) AS latest_quarter_date
  FROM qt JOIN ttm t ON t.symbol = qt.symbol JOIN growth g ON g.symbol = qt.symbol JOIN beta5 b ON b.symbol = qt.symbol JOIN q l ON l.symbol = qt.symbol AND l.q = 0),
v1 AS (
  SELECT *, ttm_gross / ttm_revenue AS gross_margin_ttm, ttm_operating / ttm_revenue AS operating_profit_margin_ttm,
         CASE WHEN prior_revenue > 0 THEN ttm_revenue / prior_revenue - 1 ELSE 0 END AS yoy_revenue_growth,
         CASE WHEN prior_gross > 0 THEN (ttm_gross / ttm_revenue) / (prior_gross / prior_revenue) - 1 ELSE 0 END AS yoy_gross_margin_change,
         ttm_ebit / ttm_interest AS interest_coverage, CASE WHEN ttm_income > 0 THEN market_cap / ttm_income END AS pe_ttm,
         greatest(0, ttm_tax / ttm_pretax) AS tax, 0.0425 + beta * (0.08 - 0.0425) AS capm FROM v0),
v2 AS (
  SELECT *, least(0.35, greatest(0.02, total_equity / (total_equity + total_liabilities) * capm + total_liabilities / (total_equity + total_liabilities) * 0.0725 * (1 - tax))) AS wacc,
         ttm_revenue * CASE WHEN revenue_growth > 0.3 THEN 15 WHEN revenue_growth > 0.25 THEN 12 WHEN revenue_growth > 0.2 THEN 9 WHEN revenue_growth > 0.18 THEN 5
                            WHEN revenue_growth > 0.15 THEN 4 WHEN revenue_growth > 0.1 THEN 2.5 ELSE 1 END AS revenue_value FROM v1),
v3 AS (
  SELECT *, CASE WHEN ttm_ocf > 0 AND ocf_years >= 3 THEN
     list_sum(list_transform([1, 2, 3, 4, 5], lambda y : ttm_ocf * pow(1 + ocf_growth, y) / pow(1 + wacc, y)))
     + ttm_ocf * pow(1 + ocf_growth, 5) * 1.02 / greatest(1e-9, wacc - 0.02) / pow(1 + wacc, 5) + cash - total_debt - preferred ELSE 0 END AS ocf_value FROM v2),
v4 AS (
  SELECT *, greatest(0, (ocf_value * 0.6 + revenue_value * 0.4) / shares * 0.9
     * CASE WHEN yoy_revenue_growth > 0.5 THEN 1.2 WHEN yoy_revenue_growth > 0.25 THEN 1.15 WHEN yoy_revenue_growth > 0.1 THEN 1.1 WHEN yoy_revenue_growth > 0 THEN 1
            WHEN yoy_revenue_growth > -0.1 THEN 1 + yoy_revenue_growth ELSE 0.8 END
     * CASE WHEN gross_margin_ttm > 0.7 THEN 1.15 WHEN gross_margin_ttm > 0.6 THEN 1.1 WHEN gross_margin_ttm > 0.5 THEN 1.05 WHEN gross_margin_ttm > 0.4 THEN 1
            WHEN gross_margin_ttm > 0.3 THEN 0.9 WHEN gross_margin_ttm > 0.2 THEN 0.8 ELSE 0.7 END) AS target_price FROM v3),
vals AS (
  SELECT *, target_price / price - 1 AS upside_pct, CASE WHEN target_price / price - 1 > 0 THEN 'Buy' ELSE 'Sell/Neutral' END AS signal,
         least(1, abs(target_price / price - 1)) AS signal_strength,
         CASE WHEN avg_50 > avg_200 THEN 'G' ELSE 'D' END || CASE WHEN price < avg_50 THEN 'v' ELSE '^' END || ' ' ||
         printf('%.2f', CASE WHEN avg_50 > avg_200 THEN (avg_200 - price) / (avg_200 - year_high) ELSE -(avg_200 - price) / (avg_200 - year_low) END) AS gdx_ratio
  FROM v4)"""

VALUE_SPEC = (
    "symbol:i price:x latest_quarter_date:t signal:s gdx_ratio:s gross_margin_ttm:d operating_profit_margin_ttm:d yoy_revenue_growth:d yoy_gross_margin_change:d "
    "interest_coverage:d4 pe_ttm:d5 risk_free_rate:d wacc:d revenue_value:d1 ocf_value:d-4 target_price:d4 upside_pct:d5 signal_strength:d5 beta:d5"
)


def valued(spark, folder):
    s = statements(spark, folder)
    beta = va.monthly_beta(weekly_bars(spark, folder), benchmark_bars(spark, folder))
    return va.value_companies(
        quotes(spark, folder), s["income"], s["cash"], s["annual_income"], s["annual_cash"], s["balance"], beta, F.lit(4.25)
    )


@query("v4_v8_valuation", VALUE_SPEC, with_(WEEKLY, MONTHLY, BETA_SQL, STATEMENTS, VALUES, select="SELECT *, 0.0425 AS risk_free_rate FROM vals"))
def valuation(spark, folder):
    return valued(spark, folder)


@query("v9_ranked_table", "symbol:i upside_pct:d5 signal_strength:d5 place:i", with_(WEEKLY, MONTHLY, BETA_SQL, STATEMENTS, VALUES, select="""
       SELECT symbol, upside_pct, signal_strength, row_number() OVER (ORDER BY upside_pct DESC NULLS LAST, signal_strength DESC NULLS LAST, symbol) AS place FROM vals"""))
def ranked(spark, folder):
    return va.ranked_table(valued(spark, folder))
