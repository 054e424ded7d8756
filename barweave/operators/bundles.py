"""Saved models: one folder per trained pattern, scans and back-tests of everything saved.

A bundle folder holds the learners and the meta filter as MLlib writes them and
a one-row table of facts (names, thresholds, calibration, metrics, dates).  The
facts are written last, so a bundle that was not written whole is not listed.
Loops on the driver run over bundles (a dozen patterns); scoring is distributed.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave.functions.tables import settle
from barweave.operators import learn as ml, patterns as pt, reports as rp, signals as sg, thresholds as th

FACTS = (
    "model_file string, pattern string, interval string, horizon_bars int, model_name string, columns array<string>, blended boolean, "
    "calibration_coef double, calibration_intercept double, calibrated boolean, long_threshold double, short_threshold double, "
    "meta_enabled boolean, meta_threshold double, train_rows long, test_rows long, purged_train_rows long, positive_rate_train double, "
    "positive_rate_test double, accuracy double, precision double, recall double, f1 double, roc_auc double, cv_roc_auc double, "
    "counts map<string, long>, seed int, meta_acceptance double, train_end timestamp, test_start timestamp"
)


@dataclass
class ModelBundle:
    """Everything that turns rows of one pattern into positions."""

    pattern: str
    model: ml.StackedModel
    calibration: ml.Calibration
    long_threshold: float
    short_threshold: float
    meta: ml.MetaFilter | None
    facts: dict

    @property
    def model_file(self) -> str:
        return self.facts["model_file"]

    def thresholds(self, long_at: float | None, short_at: float | None, use_model: bool = False) -> tuple[float, float]:
        """The model's own where asked for or where none is given."""
        own = (self.long_threshold, self.short_threshold)
        return own if use_model else tuple(t if given is None else given for given, t in zip((long_at, short_at), own))

    def judge(self, rows: DataFrame, long_at: float | None = None, short_at: float | None = None, use_model: bool = False) -> DataFrame:
        """``rows`` with pred_prob_up, position, meta_prob_trade and the thresholds; absent feature columns count as missing."""
        long_at, short_at = self.thresholds(long_at, short_at, use_model)
        scored, absent = self._scored(rows)
        scored = scored.withColumn("position", sg.position(F.col("pred_prob_up"), F.lit(long_at), F.lit(short_at)))
        scored = self.meta.apply(scored) if self.meta else scored.withColumn("meta_prob_trade", F.lit(None).cast("double"))
        return scored.drop(*absent).withColumns({"long_threshold": F.lit(float(long_at)), "short_threshold": F.lit(float(short_at))})

    def _scored(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        absent = [c for c in self.facts["columns"] if c not in rows.columns]
        frame = rows.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else rows
        return self.model.score(frame).withColumn("pred_prob_up", self.calibration.apply(F.col("prob_raw"))).drop("prob_raw"), absent

    def both_sides(self, rows: DataFrame) -> DataFrame:
        """``rows`` with pred_prob_up, and whether the meta filter would let a row be bought (``may_buy``) or sold (``may_sell``)."""
        scored, absent = self._scored(rows)
        for side, flag in ((1, "may_buy"), (-1, "may_sell")):
            taken = scored.withColumn("position", F.lit(side))
            taken = self.meta.apply(taken).drop("meta_prob_trade") if self.meta else taken
            scored = taken.withColumn(flag, F.col("position") != 0).drop("position")
        return scored.drop(*absent)


def model_file(pattern: str, interval: str, horizon: int, name: str | None = None) -> str:
    return "__".join([pattern, interval, f"h{horizon}", *([name] if name else [])])


def rule_bundle(
    pattern: str,
    probability: str,
    calibration: ml.Calibration = ml.Calibration(),
    long_threshold: float = sg.DEFAULT_LONG,
    short_threshold: float = sg.DEFAULT_SHORT,
    meta_probability: str | None = None,
    meta_threshold: float = 0.55,
    interval: str = "1d",
    horizon: int = 1,
    name: str | None = None,
    **facts,
) -> ModelBundle:
    """A bundle whose learner is an SQL expression over the columns of a row, to be saved and judged like a trained one."""

    def rule(expression: str) -> Transformer:
        return SQLTransformer(statement=f"SELECT *, array(1 - ({expression}), CAST({expression} AS DOUBLE)) AS probability FROM __THIS__")

    nothing = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    meta = ml.MetaFilter(nothing, rule(meta_probability), meta_threshold) if meta_probability else None
    named = {"model_file": model_file(pattern, interval, horizon, name), "interval": interval, "horizon_bars": horizon, "model_name": name}
    return ModelBundle(pattern, ml.StackedModel(nothing, [], [rule(probability)], None), calibration, long_threshold, short_threshold, meta, named | {"columns": []} | facts)


# ---------------------------------------------------------------- files
def save_bundle(spark: SparkSession, bundle: ModelBundle, folder: str) -> str:
    """Write a bundle under ``folder`` in the place of one with the same pattern, interval, horizon and name."""
    path = f"{folder}/{bundle.model_file}"
    facts = bundle.facts | {
        "pattern": bundle.pattern,
        "blended": bundle.model.blend is not None,
        "calibration_coef": bundle.calibration.coef,
        "calibration_intercept": bundle.calibration.intercept,
        "calibrated": bundle.calibration.fitted,
        "long_threshold": bundle.long_threshold,
        "short_threshold": bundle.short_threshold,
        "meta_enabled": bundle.meta is not None,
        "meta_threshold": bundle.meta.threshold if bundle.meta else None,
    }
    row = spark.createDataFrame([facts], FACTS)
    row.limit(0).write.mode("overwrite").parquet(f"{path}/facts")  # not listed while its parts are replaced
    bundle.model.prepare.write().overwrite().save(f"{path}/prepare")
    learners = [*bundle.model.bases, *([bundle.model.blend] if bundle.model.blend is not None else [])]
    PipelineModel(learners).write().overwrite().save(f"{path}/learners")
    if bundle.meta:
        PipelineModel([bundle.meta.prepare, bundle.meta.model]).write().overwrite().save(f"{path}/meta")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return path


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all bundles under ``folder``, one row each."""
    try:
        return spark.read.schema(FACTS).parquet(f"{folder}/*/facts")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], FACTS)


def load_bundle(folder: str, facts: dict) -> ModelBundle:
    path = f"{folder}/{facts['model_file']}"
    stages = PipelineModel.load(f"{path}/learners").stages
    bases, blend = (stages[:-1], stages[-1]) if facts["blended"] else (stages, None)
    model = ml.StackedModel(PipelineModel.load(f"{path}/prepare"), list(facts["columns"]), bases, blend)
    meta = None
    if facts["meta_enabled"]:
        prepare, judge = PipelineModel.load(f"{path}/meta").stages
        meta = ml.MetaFilter(prepare, judge, facts["meta_threshold"])
    curve = ml.Calibration(facts["calibration_coef"], facts["calibration_intercept"], facts["calibrated"])
    return ModelBundle(facts["pattern"], model, curve, facts["long_threshold"], facts["short_threshold"], meta, facts)


def load_bundles(
    spark: SparkSession, folder: str, interval: str, horizon: int, patterns: Collection[str] | None = None, model_files: Collection[str] | None = None
) -> list[ModelBundle]:
    """Bundles for bars of ``interval`` and ``horizon``, optionally of some patterns or files only."""
    rows = catalog(spark, folder).where((F.col("interval") == interval) & (F.col("horizon_bars") == horizon))
    for column, wanted in (("pattern", patterns), ("model_file", model_files)):
        rows = rows.where(F.col(column).isin(list(wanted))) if wanted else rows
    return [load_bundle(folder, r.asDict()) for r in rows.orderBy("model_file").collect()]  # one row per model


# ---------------------------------------------------------------- training
def train_bundles(
    dataset: DataFrame,
    columns: Sequence[str],
    patterns: Sequence[str],
    folder: str,
    config: ml.TrainConfig = ml.TrainConfig(),
    name: str | None = None,
    cv_folds: int = 0,
) -> DataFrame:
    """Train, save and describe one model per pattern: a summary row each, with ``skipped_because`` where there is none."""
    spark, rows = dataset.sparkSession, []
    for pattern, raw, train, test, start in ml.training_parts(dataset, patterns, config):
        fitted = ml.fit_pattern(train, test, columns, config)
        base = {"pattern": pattern, "interval": config.costs.interval, "horizon_bars": config.horizon, "model_name": name}
        if isinstance(fitted, str):
            rows.append(base | {"skipped_because": fitted})
            continue
        y = F.avg(F.col("future_direction").cast("double"))
        n_train, rate_train, last = train.agg(F.count(F.lit(1)), y, F.max("datetime")).first()
        n_test, rate_test = test.agg(F.count(F.lit(1)), y).first()
        one = ml.binary_metrics(fitted.scored.withColumn("_all", F.lit(0)), ["_all"], "future_direction", "pred_prob_up").first()
        tried, kept = fitted.scored.agg(F.count("meta_prob_trade"), F.count_if(F.col("meta_prob_trade").isNotNull() & (F.col("position") != 0))).first()
        aucs = ml.purged_cv(train, fitted.model.columns, cv_folds, max(1, config.horizon), config.size) if cv_folds else None
        facts = base | {
            "model_file": model_file(pattern, config.costs.interval, config.horizon, name),
            "columns": fitted.model.columns,
            "train_rows": n_train,
            "test_rows": n_test,
            "purged_train_rows": max(0, raw.count() - n_train),
            "positive_rate_train": rate_train,
            "positive_rate_test": rate_test,
            **{m: one[m] for m in ("accuracy", "precision", "recall", "f1", "roc_auc")},
            "cv_roc_auc": aucs.agg(F.avg("roc_auc")).first()[0] if aucs is not None else None,
            "counts": fitted.counts,
            "seed": fitted.facts["seed"],
            "meta_acceptance": kept / tried if tried else None,
            "train_end": last,
            "test_start": start,
        }
        bundle = ModelBundle(pattern, fitted.model, fitted.calibration, fitted.facts["long_threshold"], fitted.facts["short_threshold"], fitted.meta, facts)
        save_bundle(spark, bundle, folder)
        keep = facts | {"long_threshold": bundle.long_threshold, "short_threshold": bundle.short_threshold, "meta_enabled": fitted.meta is not None}
        rows.append(keep | {"skipped_because": None})
    return spark.createDataFrame(rows, f"{FACTS}, skipped_because string")


# ---------------------------------------------------------------- use
def _union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return every


def scan_saved_models(
    latest: DataFrame,
    folder: str,
    interval: str = "1d",
    horizon: int = 1,
    long_at: float | None = None,
    short_at: float | None = None,
    use_model: bool = False,
    min_confidence: float = 0.0,
    top_n: int = 50,
    patterns: Collection[str] | None = None,
    model_files: Collection[str] | None = None,
) -> DataFrame:
    """Ranked signals of all saved models on the newest row of each symbol; meta filters can turn a signal flat."""
    spark = latest.sparkSession
    rows = settle(rp.latest_rows(latest))
    out = []
    for bundle in load_bundles(spark, folder, interval, horizon, patterns, model_files):
        judged = bundle.judge(pt.pattern_subset(rows, bundle.pattern), long_at, short_at, use_model)
        out.append(
            judged.select(
                "symbol",
                "datetime",
                F.lit(bundle.pattern).alias("pattern"),
                F.lit(bundle.model_file).alias("model_file"),
                F.col("pred_prob_up").alias("prob_up"),
                "position",
                "meta_prob_trade",
                F.lit(bundle.facts.get("roc_auc")).cast("double").alias("model_roc_auc"),
                "long_threshold",
                "short_threshold",
            )
        )
    if not out:
        kinds = "symbol string, datetime timestamp, pattern string, model_file string, prob_up double, position int, meta_prob_trade double, model_roc_auc double, long_threshold double, short_threshold double"
        out = [spark.createDataFrame([], kinds)]
    return rp.scan_signals(_union(out), min_confidence, top_n)


@dataclass
class Backtest:
    """``signals``: judged rows with a position; ``trades``: those with a return; ``summary``: a row per model;
    ``periods``: returns of each curve variant by date, input of :func:`barweave.operators.signals.equity_curve`."""

    signals: DataFrame
    trades: DataFrame
    summary: DataFrame
    periods: DataFrame

    def curves(self, initial: float = 10_000.0) -> DataFrame:
        return sg.equity_curve(self.periods, ["pattern", "model_file", "curve_variant"], initial)


def _pool(dataset: DataFrame, folder: str, costs: sg.Costs, embargo_bars: int, patterns, model_files):
    """The saved models, their dates, the dataset with realized returns, and the rows each model may be judged on."""
    spark = dataset.sparkSession
    bundles = load_bundles(spark, folder, costs.interval, costs.horizon, patterns, model_files)
    if not bundles:
        raise ValueError(f"no saved model for {costs.interval} bars and horizon {costs.horizon} under {folder}")
    full = settle(sg.add_realized_return(dataset, costs.horizon, costs.latency))
    known = [(b.model_file, b.pattern, b.facts.get("train_end"), b.facts.get("test_start")) for b in bundles]
    models = spark.createDataFrame(known, "model_file string, pattern string, train_end timestamp, test_start timestamp")
    return bundles, models, full, settle(sg.out_of_sample(pt.fan_out(full).drop("pattern"), models, costs.interval, embargo_bars, full))


def optimize_saved_models(
    dataset: DataFrame,
    folder: str,
    costs: sg.Costs = sg.Costs(),
    long_at: float | None = None,
    short_at: float | None = None,
    embargo_bars: int = 0,
    min_trades: int = 20,
    patterns: Collection[str] | None = None,
    model_files: Collection[str] | None = None,
) -> DataFrame:
    """Best threshold pair of every saved model on the rows after its training, behind its meta filter.

    The pair to beat is ``long_at`` and ``short_at``, or else the model's own.
    """
    bundles, _, _, pool = _pool(dataset, folder, costs, embargo_bars, patterns, model_files)
    out = []
    for b in bundles:
        rows = sg.drop_extreme(settle(b.both_sides(pool.where(F.col("model_file") == b.model_file))))
        now = b.thresholds(long_at, short_at)
        keep = (F.col("may_buy"), F.col("may_sell"))
        out.append(th.optimize_out_of_sample(rows, ["pattern", "model_file"], costs, *now, min_trades=min_trades, interval=costs.interval, keep=keep))
    return _union(out)


def backtest_saved_models(
    dataset: DataFrame,
    folder: str,
    costs: sg.Costs = sg.Costs(),
    long_at: float | None = None,
    short_at: float | None = None,
    use_model: bool = False,
    embargo_bars: int = 0,
    patterns: Collection[str] | None = None,
    model_files: Collection[str] | None = None,
) -> Backtest:
    """Every saved model on the rows of its pattern after its training, with costs.

    ``dataset`` has prices, pattern flags, features and ``split``.  Returns are realized on the whole dataset before rows
    are chosen, so the last rows of a pattern do not lose their exit bar.
    """
    bundles, models, full, pool = _pool(dataset, folder, costs, embargo_bars, patterns, model_files)
    judged = settle(_union([b.judge(pool.where(F.col("model_file") == b.model_file), long_at, short_at, use_model) for b in bundles]))
    keys = ["pattern", "model_file"]
    signals = judged.where(F.col("position") != 0).withColumn("score", F.col("pred_prob_up") - 0.5)
    trades = sg.drop_extreme(signals.where(F.col("realized_return").isNotNull()))
    trades = trades.withColumn("strategy_return", costs.net(F.col("position"), F.col("realized_return")))
    # dates of the dataset that each model is judged on: one row per date and model
    dates = full.groupBy("datetime").agg(F.max("split").alias("split"))
    dated = sg.first_judged(models, full, costs.interval, embargo_bars)
    judged_dates = settle(dates.crossJoin(F.broadcast(dated)).where(sg.is_judged()).select(*keys, "datetime"))  # one row per model is broadcast
    span = judged_dates.groupBy(*keys).agg(F.min("datetime").alias("backtest_start"), F.max("datetime").alias("backtest_end"))
    summary = sg.summary(trades, keys, costs.interval).join(span, keys)
    blind = sg.blind_trades(pool, costs)
    universe = judged_dates.join(sg.universe_baseline(full), "datetime")
    variants = {"ml_model": sg.period_returns(trades, keys), "baseline_blind_pattern": sg.period_returns(blind, keys), "baseline_universe_eqw": universe}
    periods = _union([v.select(*keys, "datetime", "period_return", F.lit(k).alias("curve_variant")) for k, v in variants.items()])
    return Backtest(signals, trades, summary, periods)

