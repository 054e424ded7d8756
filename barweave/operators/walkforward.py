"""Walk forward: a model per window and pattern, fitted side by side, and one report over all their trades.

Rows are written once by pattern, in one distributed job.  Each fit writes the rows of its window for as long as it runs, and
its scores as a part of one table, so the driver holds neither rows nor a growing plan; a bounded
number of fits runs at a time.  The report is a handful of grouped aggregates over that table, whatever the number of windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barweave.functions.tables import passing, settle, shared_folder
from barweave.operators import labels as lb, learn as ml, patterns as pt, portfolio as pf, signals as sg

MODEL_FILE = "walk_forward_retrain"
# Columns a signal carries on for portfolios, where the dataset has them.
CARRIED = ("volatility_20", "beta_63", "market_cap")

#: Training and test rows of one window and pattern in; the test rows with ``pred_prob_up`` and ``position``
#: (and ``meta_prob_trade``) out, or why there is no model.
Trainer = Callable[[DataFrame, DataFrame], "DataFrame | str"]


@dataclass(frozen=True)
class Retrain:
    """Selection, stacked model, calibration, thresholds and meta filter anew for every window."""

    columns: Sequence[str]
    config: ml.TrainConfig

    @property
    def together(self) -> bool:
        """Whether nothing of a fit waits for its thresholds, so that those of all windows can be tuned at once."""
        return len(self.config.seeds) == 1 and not self.config.meta_filter

    def __call__(self, train: DataFrame, test: DataFrame) -> DataFrame | str:
        fitted = ml.fit_pattern(ml.newest(train, self.config.max_rows), test, self.columns, self.config, judge_test=False)
        return fitted if isinstance(fitted, str) else fitted.scored

    def model(self, train: DataFrame, test: DataFrame) -> ml.PatternModel | str:
        train = settle(ml.newest(train, self.config.max_rows)) if self.config.max_rows else train
        return ml.fit_model(train, test, self.columns, self.config, judge_test=False)


def retrain(columns: Sequence[str], config: ml.TrainConfig) -> Trainer:
    return Retrain(columns, config)


@dataclass
class WalkForward:
    """``fits``: a row per window and pattern, with ``skipped_because``; ``scored``: all test rows of fitted models;
    ``trades``: one row per symbol, date and pattern; ``summary``: a row per pattern; ``periods``: returns of each curve by date."""

    fits: DataFrame
    scored: DataFrame
    trades: DataFrame
    summary: DataFrame
    periods: DataFrame

    def curves(self, initial: float = 10_000.0) -> DataFrame:
        return sg.equity_curve(self.periods, ["pattern", "model_file", "curve_variant"], initial)


def deal(dataset: DataFrame, patterns: Collection[str]) -> DataFrame:
    """Rows by pattern, written by it; ``dataset`` has label ends and realized returns.

    A row is written once, however many windows train on it; each fit takes the rows of its window from here.
    """
    hits = pt.fan_out(dataset).where(F.col("member").isin(list(patterns)))
    return settle(hits.drop("pattern", "split").withColumnRenamed("member", "pattern"), by="pattern")


def window_rows(dealt: DataFrame, windows: DataFrame, config: ml.TrainConfig) -> DataFrame:
    """Rows of each pattern that train or test in the one window of ``windows``, with ``role`` and ``window_start``."""
    met = lb.with_roles(dealt.crossJoin(F.broadcast(windows)), config.costs.interval, config.embargo_bars)
    met = met.withColumn("window_start", lb.embargoed(F.col("test_start"), config.costs.interval, config.embargo_bars))
    return met.drop("train_start", "test_start", "test_end")


def fit_windows(
    dealt: DataFrame, windows: DataFrame, trainer: Trainer, config: ml.TrainConfig, min_rows: int, workers: int
) -> tuple[DataFrame, DataFrame]:
    """``(fits, scored)``: fits run as concurrent Spark jobs, at most ``workers`` at a time, each into a part of one table.

    The rows of a window and all that is made of them while it is fitted are written for that fit and removed with its end.
    Models that only need thresholds are scored first; the thresholds of all of them then come from one search.  An error of
    a fit is raised; nothing is left out silently.
    """
    spark = dealt.sparkSession
    together = isinstance(trainer, Retrain) and trainer.together
    held_path = f"{shared_folder(spark)}/side/held-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/side/scored-{uuid.uuid4().hex}"
    extra = [c for c in CARRIED if c in dealt.columns]
    kinds = {c: dealt.schema[c].dataType.simpleString() for c in ("symbol", "datetime", "realized_return")}
    kinds |= {"window_start": windows.schema["test_start"].dataType.simpleString()} | {c: dealt.schema[c].dataType.simpleString() for c in extra}
    kinds |= {"pred_prob_up": "double", "position": "int", "meta_prob_trade": "double"}
    is_test = F.col("role") == "test"
    roles = lb.assign_windows(dealt.select("pattern", "datetime", "label_end_datetime"), windows, config.costs.interval, config.embargo_bars)
    sizes = roles.groupBy("window_no", "pattern").agg(F.count_if(~is_test).alias("train_rows"), F.count_if(is_test).alias("test_rows"))
    parts = sizes.orderBy("window_no", "pattern").collect()  # one row per window and pattern

    def fit(part) -> str | int | None:
        """Why there is no model; of models without thresholds, how many rows these can be tuned on."""
        if part.train_rows < min_rows:
            return f"fewer than {min_rows} training rows"
        if not part.test_rows:
            return "no row in the test rows"
        with passing(spark):
            own = window_rows(dealt.where(F.col("pattern") == part.pattern), windows.where(F.col("window_no") == part.window_no), config)
            return fit_rows(part, settle(own, by="role"))

    def fit_rows(part, own: DataFrame) -> str | int | None:
        train, test = own.where(~is_test), own.where(is_test)
        place = f"window_no={part.window_no}/pattern={part.pattern}"
        if together:
            fitted = trainer.model(train, test)
            if isinstance(fitted, str):
                return fitted
            if fitted.held_rows:
                held = fitted.held.select("datetime", "pred_prob_up", F.col("future_excess_return").cast("double"), F.lit(fitted.held_rows).cast("long").alias("held_rows"))
                held.write.parquet(f"{held_path}/{place}")
            scored = fitted.model.score(test).withColumn("pred_prob_up", fitted.calibration.apply(F.col("prob_raw")))
        else:
            scored = trainer(train, test)
            if isinstance(scored, str):
                return scored
        absent = {c: F.lit(None) for c in kinds if c not in scored.columns}
        scored.withColumns(absent).select(*[F.col(c).cast(kind) for c, kind in kinds.items()]).write.parquet(f"{path}/{place}")
        return fitted.held_rows if together else None

    with ThreadPoolExecutor(max(1, workers)) as pool:
        ends = list(pool.map(fit, parts))
    reasons = [e if isinstance(e, str) else None for e in ends]
    table = [(p.window_no, p.pattern, p.train_rows, p.test_rows, why) for p, why in zip(parts, reasons)]
    fits = spark.createDataFrame(table, "window_no int, pattern string, train_rows long, test_rows long, skipped_because string")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()) + ", window_no int, pattern string"
    scored = spark.read.schema(schema).parquet(path) if None in reasons else spark.createDataFrame([], schema)
    if not together or None not in reasons:
        return fits, scored
    long_at, short_at = (F.lit(x) for x in ml.DEFAULT_PAIR)
    if any(isinstance(e, int) and e for e in ends):
        kind = dealt.schema["datetime"].dataType.simpleString()
        held = spark.read.schema(f"datetime {kind}, pred_prob_up double, future_excess_return double, held_rows long, window_no int, pattern string").parquet(held_path)
        tuned = ml.tune(held, ["window_no", "pattern", "held_rows"], F.col("held_rows"), trainer.config.costs)
        pairs = settle(tuned.select("window_no", "pattern", "long_threshold", "short_threshold"), lasting=True)  # one row per window and pattern
        scored = scored.join(F.broadcast(pairs), ["window_no", "pattern"], "left")
        long_at, short_at = F.coalesce("long_threshold", long_at), F.coalesce("short_threshold", short_at)
    sided = scored.withColumn("position", sg.position(F.col("pred_prob_up"), long_at, short_at).cast("int"))
    return fits, sided.select(*kinds, "window_no", "pattern")


def walk_forward(
    dataset: DataFrame,
    windows: DataFrame,
    trainer: Trainer,
    config: ml.TrainConfig = ml.TrainConfig(),
    patterns: Collection[str] = (*pt.PATTERNS, pt.NO_PATTERN),
    min_rows: int = 120,
    workers: int = 4,
    rows: Column | None = None,
) -> WalkForward:
    """Retrain in every window of :func:`barweave.operators.labels.walk_forward_windows` and report trades with costs.

    Returns are realized and label ends taken on all bars, before rows are dealt to windows.  The blind and the universe
    curve of a pattern cover the windows in which its models traded, under the same purge and embargo.  ``rows`` tells which
    rows models are trained and judged on; the universe curve keeps all.
    """
    windows = settle(windows)
    full = settle(ml.add_training_label_end(sg.add_realized_return(dataset, config.costs.horizon, config.costs.latency), config))
    with passing(dataset.sparkSession):
        dealt = deal(full if rows is None else full.where(rows), patterns)
        fits, scored = fit_windows(dealt, windows, trainer, config, min_rows, workers)
    keys = ["pattern", "model_file"]
    named = scored.withColumn("model_file", F.lit(MODEL_FILE))
    usable = sg.drop_extreme(named.where(F.col("realized_return").isNotNull()))
    active = usable.where(F.col("position") != 0).withColumns(
        {"strategy_return": config.costs.net(F.col("position"), F.col("realized_return")), "score": F.col("pred_prob_up") - 0.5}
    )
    used = settle(active.select(*keys, "window_no").distinct())  # one row per window and pattern
    trades = settle(sg.dedupe_windows(active, keys))
    counts = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows_used"))
    summary = sg.summary(trades, keys, config.costs.interval).join(counts, keys)
    blind = sg.blind_trades(usable.join(used, [*keys, "window_no"], "left_semi"), config.costs, "pattern")
    judged = lb.assign_windows(full.select("datetime", "label_end_datetime", "realized_return"), windows, config.costs.interval, config.embargo_bars)
    of_window = sg.drop_extreme(judged.where((F.col("role") == "test") & F.col("realized_return").isNotNull()))
    of_window = of_window.groupBy("window_no", "datetime").agg(F.avg("realized_return").alias("_mean"))
    universe = of_window.join(used, "window_no").groupBy(*keys, "datetime").agg(F.avg("_mean").alias("period_return"))
    variants = {"ml_model": sg.period_returns(trades, keys), "baseline_blind_pattern": sg.period_returns(blind, keys), "baseline_universe_eqw": universe}
    every = [v.select(*keys, "datetime", "period_return", F.lit(k).alias("curve_variant")) for k, v in variants.items()]
    return WalkForward(fits, scored, trades, summary, every[0].unionByName(every[1]).unionByName(every[2]))


def walk_forward_portfolio(result: WalkForward, costs: sg.Costs, best: int | None = None, min_trades: int = 40, min_win_rate: float = 0.55, **rules) -> DataFrame:
    """Weighted trades over the signals of all patterns, or of the ``best`` by objective; ``rules`` as in ``portfolio_trades``."""
    signals = result.trades
    if best:
        chosen = pf.best_patterns(result.summary, best, min_trades, min_win_rate)  # a row per pattern
        signals = signals.join(settle(chosen.select("pattern")), "pattern", "left_semi")
    return pf.portfolio_trades(signals.select("symbol", "datetime", "score", "realized_return", "volatility_20"), costs, **rules)
