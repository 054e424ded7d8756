"""Queries: feature preparation, classifiers and validation over the weekly model dataset."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barweave.functions.tables import passing, settle, shared_folder
from barweave.operators import base_features as bf, bundles as mb, context as cx, labels as lb, learn as ml, patterns as pt, portfolio as pf, reports as rp, signals as sg, walkforward as wf
from barweave.plans.context import guard
from barweave.plans.core import CUT, METRIC_COLS, SCORE, WINDOWS, blind_trades
from barweave.plans.registry import query, rounded
from barweave.plans.sqlparts import BLIND, FLAGS, FUTURE, MEMBERS, REALIZED, RETURNS, TRADE_METRICS, WEEKLY, metrics_sql, with_
from barweave.plans.strategy import LONGS2, PICKED, SHORTS2, SIGNAL_PARTS, SIZED, grid_values, pair_sql, scored_members, tie
from barweave.sources.demo import table, weekly_bars

FEATURES = ["ret_1", "ret_2", "ret_5", "hl_spread", "co_spread", "gap", "volatility_20", "z_close_20", "z_volume_20", "up_streak", "down_streak"]
SMALL = ml.LearnerSize(rounds=3, trees=5, depth=3, folds=2)
QUICK = ml.LearnerSize(rounds=3, trees=5, depth=3, fast=True)
PATTERNS = ("doji", "bullish_engulfing")


def dataset(spark, folder):
    """Features, labels, patterns and split, written once for the training jobs."""
    with passing(spark):
        return settle(_dataset(settle(weekly_bars(spark, folder))), lasting=True)


def _dataset(bars):
    frame = bf.add_shape(bf.add_returns(pt.add_patterns(bars)))
    frame = bf.add_streaks(bf.add_rolling(frame, (20,)))
    labeled = lb.drop_unlabeled(lb.add_market_labels(lb.add_future_return(frame)).withColumn("future_direction", lb.direction("excess")))
    dates = lb.add_future_return(bars).where(F.col("future_return").isNotNull())
    kept = ["symbol", "datetime", "close", "pattern", "future_return", "future_excess_return", "future_direction", *FEATURES]
    flags = [pt.pattern_column(p) for p in pt.PATTERNS]
    return lb.chronological_split(labeled, dates=dates).select(*kept, *flags, "split")


@query("x1_impute", "symbol:i datetime:t volatility_20:d z_close_20:d")
def impute(spark, folder):
    return ml.impute(dataset(spark, folder), ["volatility_20", "z_close_20"])


Q_COLS = ["ret_1", "ret_10", "far_vol", "flat", "never"]


@query("x2_column_quality", "feature:s missing_rate:d varies:s kept:s", with_(WEEKLY, RETURNS, f"""
q AS (SELECT ret_1, ret_10, {guard("stddev_samp(ret_1)", "ret_1", 200, 200)} AS far_vol, 1.0 AS flat, CAST(NULL AS DOUBLE) AS never FROM rets),
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, 1 - count({c}) / count(*) AS missing_rate, coalesce(min({c}) < max({c}), false) AS v FROM q" for c in Q_COLS)})""",
       select="SELECT feature, missing_rate, CAST(v AS VARCHAR) AS varies, CAST(v AND missing_rate <= 0.65 AS VARCHAR) AS kept FROM l"))
def column_quality(spark, folder):
    from barweave.functions.windows import by_symbol, roll_std

    frame = bf.add_returns(weekly_bars(spark, folder)).withColumns(
        {
            "far_vol": roll_std(F.col("ret_1"), by_symbol(), 200, 200),
            "flat": F.lit(1.0),
            "never": F.lit(None).cast("double"),
        }
    )
    return ml.column_quality(frame, Q_COLS)


@query("x3_correlation_pruning", "feature:s")
def correlation_pruning(spark, folder):
    frame = dataset(spark, folder).withColumn("ret_1_twin", F.col("ret_1") * 2.0 + 1.0)
    kept = ml.uncorrelated_columns(frame, [*FEATURES, "ret_1_twin"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("x4_permutation_importance", "feature:s importance_mean:d importance_std:d importance_abs:d rank:i")
def permutation_importance(spark, folder):
    """Importance for the whole stack: all base learners, their out-of-fold probabilities and the blend."""
    frame = dataset(spark, folder)
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    return ml.permutation_importance(ml.fit_stacked(train, FEATURES, 42, SMALL), test)


@query("x5_importance_share", "pattern:s feature:s importance_mean:d cum_share:d place:i", """
WITH imp AS (SELECT p_type AS pattern, p_name || '|' || p_brand AS feature, max(p_retailprice - 950) AS importance_mean FROM part GROUP BY 1, 2),
c AS (SELECT *, sum(importance_mean) OVER (PARTITION BY pattern ORDER BY importance_mean DESC, feature ROWS UNBOUNDED PRECEDING) / sum(importance_mean) OVER (PARTITION BY pattern) AS cum_share,
             row_number() OVER (PARTITION BY pattern ORDER BY importance_mean DESC, feature) AS place FROM imp WHERE importance_mean > 0)
SELECT * FROM c WHERE cum_share <= 0.9 OR place <= 5""")
def importance_share(spark, folder):
    imp = table(spark, folder, "part").groupBy(F.col("p_type").alias("pattern"), F.concat_ws("|", "p_name", "p_brand").alias("feature")).agg(
        F.max(F.col("p_retailprice") - 950).alias("importance_mean")
    )
    return ml.select_by_share(imp, keys=["pattern"])


@query("x6_stability_support", "feature:s votes:i contexts:i support:d")
def stability_support(spark, folder):
    return ml.stability_support(dataset(spark, folder), FEATURES, 4, size=SMALL)


@query("x7_stacked_classifier", "symbol:i datetime:t prob_raw:d")
def stacked(spark, folder):
    frame = dataset(spark, folder)
    model = ml.fit_stacked(frame.where("split = 'train'"), FEATURES, 42, SMALL)
    return model.score(frame.where("split = 'test'"))


@query("x8_x10_pattern_training", "pattern:s symbol:i datetime:t pred_prob_up:d position:i meta_prob_trade:d long_threshold:d short_threshold:d")
def pattern_training(spark, folder):
    return ml.train_patterns(dataset(spark, folder), FEATURES, PATTERNS, ml.TrainConfig(size=QUICK))


NESTED = ml.SelectionConfig(min_features=4, max_features=8, folds=2)


@query("x8_training_summary", "pattern:s train_rows:i test_rows:i purged_train_rows:i positive_rate_train:d positive_rate_test:d raw_features:i dropped_missing:i dropped_constant:i dropped_correlated:i prefilter_features:i test_start:t",
       with_(WEEKLY, FLAGS, FUTURE, """
lab AS (SELECT l.*, f.* EXCLUDE (symbol, datetime, open, high, low, close, volume), lead(l.datetime) OVER (PARTITION BY l.symbol ORDER BY l.datetime) AS label_end
        FROM labels l JOIN labeled f ON f.symbol = l.symbol AND f.datetime = l.datetime WHERE l.future_return IS NOT NULL),
ld AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT datetime FROM lab)),
lc AS (SELECT datetime AS cutoff FROM ld WHERE i = greatest(1, least(CAST(floor(n * 0.8) AS BIGINT), n - 1))),
both_names AS (SELECT 'doji' AS member, * FROM lab WHERE pattern_doji = 1 UNION ALL SELECT 'bullish_engulfing', * FROM lab WHERE pattern_bullish_engulfing = 1)""", select="""
SELECT member AS pattern, count(*) FILTER (WHERE datetime < cutoff AND label_end < cutoff) AS train_rows, count(*) FILTER (WHERE datetime >= cutoff) AS test_rows,
       count(*) FILTER (WHERE datetime < cutoff) - count(*) FILTER (WHERE datetime < cutoff AND label_end < cutoff) AS purged_train_rows,
       avg(CAST(future_excess_return > 0 AS INT)) FILTER (WHERE datetime < cutoff AND label_end < cutoff) AS positive_rate_train,
       avg(CAST(future_excess_return > 0 AS INT)) FILTER (WHERE datetime >= cutoff) AS positive_rate_test,
       12 AS raw_features, 1 AS dropped_missing, 1 AS dropped_constant, 1 AS dropped_correlated, 9 AS prefilter_features, min(datetime) FILTER (WHERE datetime >= cutoff) AS test_start
FROM both_names, lc GROUP BY 1"""))
def training_summary(spark, folder):
    """Trained, selected and saved models, one summary row each; a twin, a constant and an empty feature have to go."""
    frame = dataset(spark, folder).withColumns({"ret_1_twin": F.col("ret_1") * 2.0 + 1.0, "flat": F.lit(1.0), "never": F.lit(None).cast("double")})
    config = ml.TrainConfig(size=QUICK, selection=NESTED)
    saved = f"{shared_folder(spark)}/side/bundles-{uuid.uuid4().hex}"
    varied = [c for c in FEATURES if not c.endswith("_streak")]  # an engulfing bar has only one kind of streak
    table = mb.train_bundles(frame, [*varied, "ret_1_twin", "flat", "never"], PATTERNS, saved, config)
    return table.select("*", *[F.col("counts")[c].alias(c) for c in ("raw_features", "dropped_missing", "dropped_constant", "dropped_correlated", "prefilter_features")])


@query("x9_platt_apply", "symbol:i datetime:t pattern:s calibrated:d", with_(*SIGNAL_PARTS, """
c AS (SELECT *, least(1 - 1e-6, greatest(1e-6, pred_prob_up)) AS p FROM scored_members)""", select="""
SELECT symbol, datetime, pattern, least(1 - 1e-6, greatest(1e-6, 1 / (1 + exp(-(0.8 * ln(p / (1 - p)) - 0.1))))) AS calibrated FROM c"""))
def platt_apply(spark, folder):
    curve = ml.Calibration(0.8, -0.1, True)
    return scored_members(spark, folder).withColumn("calibrated", curve.apply(F.col("pred_prob_up")))


@query("x9_platt_fit", "coef:d intercept:d fitted:s")
def platt_fit(spark, folder):
    frame = sg.add_realized_return(bf.add_returns(weekly_bars(spark, folder)))
    rows = frame.where(F.col("ret_1").isNotNull() & F.col("realized_return").isNotNull()).select(
        (F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("ret_1") * -2.0))).alias("prob_raw"), (F.col("realized_return") > 0).cast("int").alias("future_direction")
    )
    c = ml.fit_calibration(rows)
    return spark.createDataFrame([(c.coef, c.intercept, str(c.fitted).lower())], "coef double, intercept double, fitted string")


@query("x11_binary_metrics", "pattern:s rows:i " + rounded("accuracy precision recall f1 roc_auc"), with_(*SIGNAL_PARTS, """
lv AS (SELECT pattern, realized_return > 0 AS y, pred_prob_up >= 0.5 AS u, pred_prob_up AS s FROM scored_members WHERE realized_return IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY pattern ORDER BY s) + (count(*) OVER (PARTITION BY pattern, s) - 1) / 2.0 AS r FROM lv),
ag AS (SELECT pattern, count(*) AS rows, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE u) AS up, count(*) FILTER (WHERE y AND u) AS hit,
              sum(r) FILTER (WHERE y) AS rs FROM rk GROUP BY 1)""", select="""
SELECT pattern, rows, (hit + rows - up - pos + hit) / rows AS accuracy, coalesce(hit / nullif(up, 0), 0) AS precision, coalesce(hit / nullif(pos, 0), 0) AS recall,
       coalesce(2 * hit / nullif(up + pos, 0), 0) AS f1, (rs - pos * (pos + 1) / 2.0) / nullif(pos * (rows - pos), 0) AS roc_auc FROM ag"""))
def binary_metrics(spark, folder):
    rows = scored_members(spark, folder).where(F.col("realized_return").isNotNull())
    return ml.binary_metrics(rows.withColumn("y", (F.col("realized_return") > 0).cast("int")), ["pattern"], "y", "pred_prob_up")


@query("x12_purged_cv", "fold:i rows:i roc_auc:d")
def purged_cv(spark, folder):
    return ml.purged_cv(dataset(spark, folder), FEATURES, 3, 1, QUICK)


@query("x13_walk_forward", "window_no:i pattern:s symbol:i datetime:t pred_prob_up:d position:i")
def walk_forward(spark, folder):
    """Scores of models retrained in every window for every pattern."""
    frame = dataset(spark, folder).drop("split")
    windows = lb.walk_forward_windows(frame, 1200, 400, 400)
    config = ml.TrainConfig(size=QUICK, meta_filter=False)
    return wf.walk_forward(frame, windows, wf.retrain(FEATURES, config), config, workers=8).scored


# a rule with one learned number, the mean of ret_1 over the training rows, so that a twin can retrain it
WALK = sg.Costs(latency=1)
WALK_PARTS = (WEEKLY, FLAGS, MEMBERS, RETURNS, WINDOWS, f"""
walk_ends AS (
  SELECT symbol, datetime, ret_1, lead(datetime, 3) OVER w AS label_end, lead(close, 2) OVER w / lead(close) OVER w - 1 AS realized_return
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
walk_rows AS (
  SELECT member AS pattern, window_no, e.*,
         CASE WHEN datetime >= test_start + INTERVAL 1 DAY AND datetime < test_end AND label_end < test_end THEN 'test'
              WHEN datetime >= train_start AND datetime < test_start AND label_end < test_start + INTERVAL 1 DAY THEN 'train' END AS role,
         test_start + INTERVAL 1 DAY AS window_start
  FROM walk_ends e JOIN members m USING (symbol, datetime), win WHERE e.ret_1 IS NOT NULL),
walk_fit AS (
  SELECT pattern, window_no, avg(ret_1) AS center FROM walk_rows WHERE role = 'train' GROUP BY 1, 2 HAVING count(*) >= 120),
walk_test AS (
  SELECT r.*, 1 / (1 + exp(-20 * (ret_1 - center))) AS pred_prob_up FROM walk_rows r JOIN walk_fit USING (pattern, window_no)
  WHERE role = 'test' AND abs(realized_return) <= 3),
walk_trades AS (
  SELECT *, position * realized_return - 5.0 / 10000 - CASE WHEN position < 0 THEN 2 * 0.5 / 10000 ELSE 0 END AS strategy_return
  FROM (SELECT *, CASE WHEN pred_prob_up <= 0.45 THEN -1 WHEN pred_prob_up >= 0.55 THEN 1 ELSE 0 END AS position FROM walk_test) WHERE position <> 0),
walk_used AS (SELECT DISTINCT pattern, window_no FROM walk_trades)""")


def walked(spark, folder) -> wf.WalkForward:
    def centered(train, test):
        center = train.agg(F.avg("ret_1")).first()[0]
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp((F.col("ret_1") - F.lit(center)) * -20.0))
        return test.withColumn("pred_prob_up", prob).withColumn("position", sg.position(F.col("pred_prob_up"), F.lit(0.55), F.lit(0.45)))

    frame = bf.add_rolling(bf.add_shape(bf.add_returns(pt.add_patterns(weekly_bars(spark, folder)))), (20,))
    # what models and reports look at; a row is dealt to several windows
    frame = frame.select("symbol", "datetime", "close", "ret_1", "volatility_20", "pattern", *[pt.pattern_column(p) for p in pt.PATTERNS])
    windows = lb.walk_forward_windows(frame, 730, 365, 365)
    # rows without a return have nothing to be judged by; label ends and realized returns still see them
    return wf.walk_forward(frame, windows, centered, ml.TrainConfig(costs=WALK, embargo_bars=1), workers=8, rows=F.col("ret_1").isNotNull())


@query("x13_walk_forward_trades", "pattern:s window_start:t symbol:i datetime:t pred_prob_up:d realized_return:d strategy_return:d",
       with_(*WALK_PARTS, select="SELECT * FROM walk_trades"))
def walk_trades(spark, folder):
    return walked(spark, folder).trades


@query("x13_walk_forward_summary", "pattern:s model_file:s windows_used:i trades:i " + rounded("win_rate_trade avg_trade_return profit_factor " + METRIC_COLS, "d5") + " start_datetime:t end_datetime:t",
       with_(*WALK_PARTS, "wp AS (SELECT pattern, datetime, avg(strategy_return) AS period_return FROM walk_trades GROUP BY 1, 2)", metrics_sql("wp", "pattern"),
             f"t AS (SELECT pattern, 'walk_forward_retrain' AS model_file, count(DISTINCT window_no) AS windows_used, {TRADE_METRICS} FROM walk_trades GROUP BY 1)",
             select="SELECT * FROM t JOIN wp_metrics USING (pattern)"))
def walk_summary(spark, folder):
    return walked(spark, folder).summary


@query("x13_walk_forward_curves", "pattern:s curve_variant:s datetime:t period_return:d cumulative_return:d5 equity_value:d1",
       with_(*WALK_PARTS, """
walk_blind AS (
  SELECT pattern, datetime, side * realized_return - 5.0 / 10000 - CASE WHEN side < 0 THEN 2 * 0.5 / 10000 ELSE 0 END AS strategy_return
  FROM (SELECT *, CASE WHEN regexp_matches(pattern, 'bearish|shooting_star|evening_star|dark_cloud_cover') THEN -1 ELSE 1 END AS side
        FROM walk_test JOIN walk_used USING (pattern, window_no))),
walk_universe AS (
  SELECT window_no, datetime, avg(realized_return) AS period_return FROM walk_ends, win
  WHERE datetime >= test_start + INTERVAL 1 DAY AND datetime < test_end AND label_end < test_end AND abs(realized_return) <= 3 GROUP BY 1, 2),
allp AS (
  SELECT pattern, 'ml_model' AS curve_variant, datetime, avg(strategy_return) AS period_return FROM walk_trades GROUP BY 1, 3
  UNION ALL SELECT pattern, 'baseline_blind_pattern', datetime, avg(strategy_return) FROM walk_blind GROUP BY 1, 3
  UNION ALL SELECT pattern, 'baseline_universe_eqw', datetime, avg(period_return) FROM walk_universe JOIN walk_used USING (window_no) GROUP BY 1, 3)""", select="""
SELECT pattern, curve_variant, datetime, greatest(period_return, -0.999999999) AS period_return,
       exp(sum(ln(1 + greatest(period_return, -0.999999999))) OVER w) - 1 AS cumulative_return, 10000 * exp(sum(ln(1 + greatest(period_return, -0.999999999))) OVER w) AS equity_value
FROM allp WINDOW w AS (PARTITION BY pattern, curve_variant ORDER BY datetime ROWS UNBOUNDED PRECEDING)"""))
def walk_curves(spark, folder):
    return walked(spark, folder).curves()


@query("x13_walk_forward_portfolio", "pattern:s trades:i " + rounded("win_rate_trade avg_trade_return profit_factor " + METRIC_COLS, "d5"),
       with_(*WALK_PARTS, f"""
walk_vol AS (SELECT symbol, datetime, {guard("stddev_samp(ret_1)", "ret_1", 20, 10)} AS volatility_20 FROM rets),
signals AS (SELECT t.*, pred_prob_up - 0.5 AS score, volatility_20 FROM walk_trades t JOIN walk_vol USING (symbol, datetime))""",
             PICKED, SIZED.replace("* 0.5 / 10000", "* 2 * 0.5 / 10000"),
             "pf AS (SELECT 'portfolio_combined_walk_forward' AS pattern, datetime, sum(strategy_return) AS period_return FROM pf_trades GROUP BY 2)",
             metrics_sql("pf", "pattern"), f"t AS (SELECT 'portfolio_combined_walk_forward' AS pattern, {TRADE_METRICS} FROM pf_trades)",
             select="SELECT * FROM t JOIN pf_metrics USING (pattern)"))
def walk_portfolio(spark, folder):
    trades = wf.walk_forward_portfolio(walked(spark, folder), WALK, min_abs_score=0.08, rebalance_every=2)
    return pf.portfolio_summary(trades, name="portfolio_combined_walk_forward")


@query("x14_net_objective", "member:s trades:i " + rounded("cumulative_return sharpe win_rate drawdown_score trade_penalty"),
       with_(WEEKLY, FLAGS, MEMBERS, REALIZED.format(source="bars"), BLIND, """
g AS (SELECT *, sum(ln(1 + greatest(strategy_return, -0.999999999))) OVER (PARTITION BY member ORDER BY datetime, symbol ROWS UNBOUNDED PRECEDING) AS s FROM blind),
d AS (SELECT *, s - max(s) OVER (PARTITION BY member ORDER BY datetime, symbol ROWS UNBOUNDED PRECEDING) AS fall FROM g)""", select="""
SELECT member, count(*) AS trades, exp(sum(ln(1 + greatest(strategy_return, -0.999999999)))) - 1 AS cumulative_return,
       avg(strategy_return) / stddev_samp(strategy_return) * sqrt(252.0) AS sharpe, avg(CASE WHEN strategy_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
       -abs(exp(min(fall)) - 1) AS drawdown_score, -ln(1 + count(*)) AS trade_penalty FROM d GROUP BY member"""))
def net_objective(spark, folder):
    return ml.net_objective(blind_trades(spark, folder), ["member"])


# ---------------------------------------------------------------- saved models
# pattern, calibration, own thresholds, meta level, training end, test start
RULES = (
    ("doji", (0.8, -0.1), (0.54, 0.44), 0.6, "1999-01-01", "1999-03-01"),
    ("bullish_engulfing", None, (0.58, 0.42), None, "2000-01-01", None),
    ("none", (1.2, 0.05), (0.56, 0.43), 0.57, None, None),
    ("hammer", None, (0.55, 0.45), None, "2030-01-01", None),
)
RULE_SQL = " UNION ALL ".join(
    f"SELECT '{p}__1d__h1__rule' AS model_file, '{p}' AS pattern, {c[0] if c else 1.0} AS ca, {c[1] if c else 0.0} AS cb, {lt} AS lt, {st} AS st, "
    f"{m if m else 0.0} AS meta, {'TIMESTAMP ' + repr(end) if end else 'CAST(NULL AS TIMESTAMP)'} AS train_end, "
    f"{'TIMESTAMP ' + repr(start) if start else 'CAST(NULL AS TIMESTAMP)'} AS test_start, {0.5 + 0.01 * i} AS auc"
    for i, (p, c, (lt, st), m, end, start) in enumerate(RULES)
)
# every pattern row with the calibrated probability and position of its model
JUDGED = f"""
rules AS ({RULE_SQL}),
raw AS (
  SELECT m.*, r.ret_1, k.model_file, ca, cb, lt, st, meta, train_end, test_start, auc, CAST(least(1 - 1e-6, greatest(1e-6, coalesce({SCORE}, 0.5))) AS DOUBLE) AS p
  FROM members m JOIN rets r USING (symbol, datetime) JOIN rules k ON k.pattern = m.member),
prob AS (SELECT *, CASE WHEN ca = 1.0 AND cb = 0.0 THEN p ELSE least(1 - 1e-6, greatest(1e-6, 1 / (1 + exp(-(ca * ln(p / (1 - p)) + cb))))) END AS pred_prob_up FROM raw),
sided AS (SELECT *, CASE WHEN pred_prob_up <= st THEN -1 WHEN pred_prob_up >= lt THEN 1 ELSE 0 END AS side FROM prob),
judged AS (
  SELECT *, CASE WHEN meta > 0 AND side <> 0 THEN 0.5 + abs(pred_prob_up - 0.5) END AS meta_prob_trade,
         CASE WHEN meta > 0 AND side <> 0 AND 0.5 + abs(pred_prob_up - 0.5) < meta THEN 0 ELSE side END AS position FROM sided)"""


def saved_rules(spark) -> str:
    """The rule models, saved as bundles in a folder of their own."""
    folder = f"{shared_folder(spark)}/side/bundles-{uuid.uuid4().hex}"
    when = lambda text: spark.sql(f"SELECT TIMESTAMP '{text}' AS t").first().t if text else None
    for i, (pattern, curve, (long_at, short_at), meta, end, start) in enumerate(RULES):
        bundle = mb.rule_bundle(
            pattern,
            "coalesce(1 / (1 + exp(-20 * ret_1)), 0.5)",
            ml.Calibration(*curve, True) if curve else ml.Calibration(),
            long_at,
            short_at,
            "0.5 + meta_abs_edge" if meta else None,
            meta or 0.55,
            name="rule",
            roc_auc=0.5 + 0.01 * i,
            train_end=when(end),
            test_start=when(start),
        )
        mb.save_bundle(spark, bundle, folder)
    return folder


@query("q1_scan_saved_models", "symbol:i datetime:t pattern:s model_file:s signal:s prob_up:d confidence:d edge:d model_roc_auc:d meta_prob_trade:d",
       with_(WEEKLY, FLAGS, MEMBERS, RETURNS, JUDGED, """
act AS (SELECT *, max(datetime) OVER (PARTITION BY symbol) AS newest FROM (SELECT *, pred_prob_up AS prob_up, CASE position WHEN 1 THEN 'up' WHEN -1 THEN 'down' END AS signal FROM judged)),
newest_bars AS (SELECT symbol, max(datetime) AS newest_bar FROM bars GROUP BY 1),
conf AS (SELECT *, CASE signal WHEN 'up' THEN prob_up ELSE 1 - prob_up END AS confidence, CASE signal WHEN 'up' THEN prob_up - lt ELSE st - prob_up END AS edge
         FROM act JOIN newest_bars USING (symbol) WHERE datetime = newest_bar AND signal IS NOT NULL)""", select="""
SELECT symbol, datetime, member AS pattern, model_file, signal, prob_up, confidence, edge, auc AS model_roc_auc, meta_prob_trade
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, auc DESC, edge DESC, member DESC) AS rk FROM conf WHERE confidence >= 0.55)
WHERE rk = 1 ORDER BY confidence DESC, model_roc_auc DESC, edge DESC, symbol LIMIT 60"""))
def scan_saved(spark, folder):
    frame = bf.add_returns(pt.add_patterns(weekly_bars(spark, folder)))
    return mb.scan_saved_models(frame, saved_rules(spark), use_model=True, min_confidence=0.55, top_n=60)


SAVED_TRADES = f"""
spans AS (SELECT max(datetime) FILTER (WHERE datetime < cutoff) AS last_train, max(datetime) AS last_date, min(cutoff) AS first_test FROM bars, cut),
starts AS (SELECT model_file, CASE WHEN start <= last_date THEN start ELSE first_test END AS judged_from
           FROM (SELECT *, greatest(coalesce(train_end, last_train), test_start) + INTERVAL 7 DAY AS start FROM rules, spans)),
{REALIZED.format(source="bars").strip()},
saved_trades AS (
  SELECT j.member AS pattern, j.model_file, j.symbol, j.datetime, j.pred_prob_up, j.position, r.realized_return,
         j.position * r.realized_return - 5.0 / 10000 - CASE WHEN j.position < 0 THEN 0.5 / 10000 ELSE 0 END AS strategy_return
  FROM judged j JOIN starts s USING (model_file) JOIN realized r ON r.symbol = j.symbol AND r.datetime = j.datetime
  WHERE j.datetime >= s.judged_from AND j.position <> 0 AND abs(r.realized_return) <= 3)"""
SAVED_PARTS = (WEEKLY, FLAGS, MEMBERS, RETURNS, CUT, JUDGED, SAVED_TRADES)


def saved_backtest(spark, folder) -> mb.Backtest:
    frame = lb.chronological_split(bf.add_returns(pt.add_patterns(weekly_bars(spark, folder))))
    return mb.backtest_saved_models(frame, saved_rules(spark), use_model=True, embargo_bars=7)


@query("r18_saved_model_trades", "pattern:s model_file:s symbol:i datetime:t pred_prob_up:d position:i strategy_return:d",
       with_(*SAVED_PARTS, select="SELECT * FROM saved_trades"))
def saved_trades(spark, folder):
    return saved_backtest(spark, folder).trades


@query("r18_saved_model_summary", "pattern:s model_file:s trades:i " + rounded("win_rate_trade avg_trade_return profit_factor " + METRIC_COLS, "d5") + " backtest_start:t backtest_end:t",
       with_(*SAVED_PARTS, "sp AS (SELECT model_file, datetime, avg(strategy_return) AS period_return FROM saved_trades GROUP BY 1, 2)", metrics_sql("sp", "model_file"),
             f"t AS (SELECT pattern, model_file, {TRADE_METRICS} FROM saved_trades GROUP BY 1, 2)",
             "span AS (SELECT model_file, min(datetime) AS backtest_start, max(datetime) AS backtest_end FROM bars JOIN starts ON datetime >= judged_from GROUP BY 1)",
             select="SELECT * FROM t JOIN sp_metrics USING (model_file) JOIN span USING (model_file)"))
def saved_summary(spark, folder):
    return saved_backtest(spark, folder).summary


@query("r19_saved_model_curves", "pattern:s model_file:s curve_variant:s datetime:t period_return:d cumulative_return:d5 equity_value:d1",
       with_(*SAVED_PARTS, f"""
blind_rows AS (
  SELECT m.member AS pattern, s.model_file, m.datetime, b.strategy_return FROM blind b JOIN members m USING (symbol, datetime, member)
  JOIN rules k ON k.pattern = m.member JOIN starts s ON s.model_file = k.model_file WHERE m.datetime >= s.judged_from),
allp AS (
  SELECT pattern, model_file, 'ml_model' AS curve_variant, datetime, avg(strategy_return) AS period_return FROM saved_trades GROUP BY 1, 2, 4
  UNION ALL SELECT pattern, model_file, 'baseline_blind_pattern', datetime, avg(strategy_return) FROM blind_rows GROUP BY 1, 2, 4
  UNION ALL SELECT k.pattern, s.model_file, 'baseline_universe_eqw', r.datetime, avg(r.realized_return) FROM realized r, starts s JOIN rules k USING (model_file)
            WHERE abs(r.realized_return) <= 3 AND r.datetime >= s.judged_from GROUP BY 1, 2, 4)""".replace("blind_rows AS", BLIND.strip() + ",\nblind_rows AS", 1), select="""
SELECT pattern, model_file, curve_variant, datetime, greatest(period_return, -0.999999999) AS period_return,
       exp(sum(ln(1 + greatest(period_return, -0.999999999))) OVER w) - 1 AS cumulative_return, 10000 * exp(sum(ln(1 + greatest(period_return, -0.999999999))) OVER w) AS equity_value
FROM allp WINDOW w AS (PARTITION BY model_file, curve_variant ORDER BY datetime ROWS UNBOUNDED PRECEDING)"""))
def saved_curves(spark, folder):
    return saved_backtest(spark, folder).curves()


@query("o2_saved_model_thresholds", "pattern:s model_file:s long_threshold:d short_threshold:d trades:i cumulative_return:d5 improvement_cumulative_return:d5",
       with_(WEEKLY, FLAGS, MEMBERS, RETURNS, CUT, JUDGED, SAVED_TRADES, f"""
oos AS (SELECT j.model_file AS pattern, j.datetime, j.pred_prob_up, r.realized_return
        FROM judged j JOIN starts s USING (model_file) JOIN realized r ON r.symbol = j.symbol AND r.datetime = j.datetime
        WHERE j.datetime >= s.judged_from AND abs(r.realized_return) <= 3 AND (meta = 0 OR 0.5 + abs(j.pred_prob_up - 0.5) >= meta))""",
             grid_values("longs", LONGS2), grid_values("shorts", SHORTS2), pair_sql("realized_return", "oos", "5.0 / 10000", 0.03),
             metrics_sql("pp", "pattern, long_threshold, short_threshold"),
             "cand AS (SELECT * FROM pp_metrics JOIN nn USING (pattern, long_threshold, short_threshold) WHERE trades >= 20)", select=f"""
SELECT split_part(pattern, '__', 1) AS pattern, pattern AS model_file, long_threshold, short_threshold, trades, cumulative_return,
       cumulative_return - before AS improvement_cumulative_return
FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY {tie('cumulative_return')} DESC, {tie('annualized_return')} DESC, {tie('sharpe')} DESC, {tie('sortino')} DESC,
                                   {tie('-abs(max_drawdown)')} DESC, win_rate_period DESC, trades DESC, long_threshold, short_threshold) AS rk,
             max(cumulative_return) FILTER (WHERE abs(long_threshold - 0.55) < 1e-9 AND abs(short_threshold - 0.45) < 1e-9) OVER (PARTITION BY pattern) AS before
      FROM cand) WHERE rk = 1"""))
def saved_thresholds(spark, folder):
    """Threshold search behind the meta filter of each saved model."""
    frame = lb.chronological_split(bf.add_returns(pt.add_patterns(weekly_bars(spark, folder))))
    return mb.optimize_saved_models(frame, saved_rules(spark), long_at=0.55, short_at=0.45, embargo_bars=7)
