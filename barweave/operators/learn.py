"""Per-pattern classifiers on Spark MLlib: imputation, feature choice, stacking, calibration, validation.

Loops on the driver run over patterns, folds or windows (a dozen at most); each
fit and each scoring pass is a distributed job.  Only numbers of the size of
the feature list ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from barweave.functions.missing import clip, ratio
from barweave.functions.tables import settle
from barweave.operators import labels as lb, patterns as pt, thresholds as th
from barweave.operators.signals import Costs, log_growth, periods_per_year, position, sharpe

# Fixed values of the training rules.
MAX_MISSING, MAX_CORRELATION = 0.65, 0.995
IMPORTANCE_SHARE, MIN_SUPPORT = 0.90, 0.55
PROB_FLOOR = 1e-6
MIN_CALIBRATION_ROWS, MIN_PLATT_ROWS = 50, 40
META_MIN_TRADES, META_MIN_CLASS, META_LOW, META_HIGH = 120, 20, 0.5, 0.95
CV_MIN_ROWS, CV_MIN_TRAIN = 500, 120
FIT_SHARE = 0.8
#: Up to so many rows a sketch of a column holds every value, so that its quantiles are exact.
SKETCH_ROWS = 20_000
#: Thresholds of a model that has no rows to tune them on.
DEFAULT_PAIR = (0.55, 0.45)


# ---------------------------------------------------------------- preparation
def middles(frame: DataFrame, columns: Sequence[str], width: float = 1e-3) -> dict[str, tuple[float, float]]:
    """The two middle values (one value twice, if the count is odd) of each column that has any; exact, NaN counts as missing.

    Approximate quantiles only bracket the middle.  What is held and ordered are the distinct values inside the bracket,
    about ``2 * width`` of them; below it they are just counted.
    """
    values = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in dict.fromkeys(columns)}
    if not values:
        return {}

    def bounds(v):
        if width >= 0.5:
            return F.array(F.min(v), F.max(v))
        return F.percentile_approx(v, F.array(F.lit(0.5 - width), F.lit(0.5 + width)), F.lit(10_000))

    rough = frame.agg(*[F.struct(F.count(v).alias("n"), bounds(v).alias("at")).alias(c) for c, v in values.items()]).first()
    known = [c for c in values if rough[c].n]
    if not known:
        return {}
    below = frame.agg(*[F.count_if(values[c] < rough[c]["at"][0]).alias(c) for c in known]).first()
    near = F.array_compact(
        F.array(*[F.when(values[c].between(*rough[c]["at"]), F.struct(F.lit(i).alias("_c"), values[c].alias("_v"))) for i, c in enumerate(known)])
    )
    counts = frame.select(F.explode(near).alias("_e")).groupBy("_e._c", "_e._v").agg(F.count(F.lit(1)).alias("_n"))
    ranks = [((rough[c].n + 1) // 2 - below[c], rough[c].n // 2 + 1 - below[c]) for c in known]
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_c").orderBy("_v")))
    low, high = (F.element_at(F.array(*[F.lit(r[k]) for r in ranks]), F.col("_c") + 1) for k in (0, 1))
    found = upto.groupBy("_c").agg(F.min(F.when(F.col("_upto") >= low, F.col("_v"))), F.min(F.when(F.col("_upto") >= high, F.col("_v"))))
    out = {known[i]: (a, b) for i, a, b in found.collect() if ranks[i][0] >= 1 and b is not None}  # one row per column
    missed = [c for c in known if c not in out]
    return out | (middles(frame, missed, width * 8) if missed else {})


def lower_medians(frame: DataFrame, columns: Sequence[str], rows: int | None = None) -> dict[str, tuple[float, ...]]:
    """As :func:`middles`, the lower value at least; a frame known to have few ``rows`` needs one pass only."""
    if rows is None or rows > SKETCH_ROWS:
        return middles(frame, columns)
    values = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in dict.fromkeys(columns)}
    if not values:
        return {}
    # a sketch merges neighbours only where its error allows for more than one row
    found = frame.agg(*[F.percentile_approx(v, F.lit(0.5), F.lit(max(10_000, 4 * rows))).alias(c) for c, v in values.items()]).first()
    return {c: (found[c],) for c in values if found[c] is not None}


def fit_imputer(frame: DataFrame, columns: Sequence[str], medians: dict[str, tuple[float, ...]] | None = None) -> ImputerModel:
    """Median imputation with exact medians (the lower of two); the fit of the library's own stage sees one row, that of the medians."""
    medians = middles(frame, columns) if medians is None else medians
    row = frame.sparkSession.createDataFrame([tuple(medians[c][0] if c in medians else None for c in columns)], ", ".join(f"`{c}` double" for c in columns))
    return Imputer(strategy="median", inputCols=list(columns), outputCols=list(columns)).fit(row)


def impute(frame: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """NULL becomes the column median; a column without any value becomes 0.  ``rows``: how many there are, if known."""
    medians = lower_medians(frame, columns, rows)
    known = [c for c in columns if c in medians]
    out = fit_imputer(frame, known, medians).transform(frame) if known else frame
    return out.fillna(0.0, list(columns))


def column_quality(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: share of missing values, whether it varies, and whether it is kept; one pass."""
    stats = frame.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(c).alias(f"{c}__n") for c in columns],
        *[(F.min(c) < F.max(c)).alias(f"{c}__v") for c in columns],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (1.0 - F.try_divide(F.col(f"{c}__n"), F.col("_n"))).alias("missing_rate"),
                F.coalesce(F.col(f"{c}__v"), F.lit(False)).alias("varies"),
            )
            for c in columns
        ]
    )
    long = stats.select(F.explode(entries).alias("_e")).select("_e.*")
    return long.withColumn("kept", (F.col("missing_rate") <= MAX_MISSING) & F.col("varies"))


def usable_columns(frame: DataFrame, columns: Sequence[str]) -> list[str]:
    kept = {r.feature for r in column_quality(frame, columns).where("kept").select("feature").collect()}
    return [c for c in columns if c in kept]


def assemble(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep")


def uncorrelated_columns(frame: DataFrame, columns: Sequence[str], limit: float = MAX_CORRELATION, rows: int | None = None) -> list[str]:
    """Drop a column that correlates above ``limit`` with any earlier one.

    The matrix is accumulated over all rows by executors; the driver receives
    features x features numbers.
    """
    if len(columns) < 2:
        return list(columns)
    vectors = assemble(columns).transform(impute(frame, columns, rows)).select("features")
    matrix = Correlation.corr(vectors, "features").first()[0].toArray()
    return [c for j, c in enumerate(columns) if not any(abs(matrix[i][j]) > limit for i in range(j))]


# ---------------------------------------------------------------- learners
def boosted(seed: int, label: str = "future_direction", rounds: int = 20, depth: int = 4) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed)


def forest(seed: int, label: str = "future_direction", trees: int = 40, depth: int = 6, subset: str = "auto") -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy=subset
    )


def logistic(label: str, features: str, weight: str | None = None) -> LogisticRegression:
    model = LogisticRegression(labelCol=label, featuresCol=features, maxIter=100)
    return model.setWeightCol(weight) if weight else model


def probability(frame: DataFrame, model: Transformer, out: str) -> DataFrame:
    """Probability of the upper class; a rule in SQL gives an array instead of a vector."""
    scored = model.transform(frame)
    plain = isinstance(scored.schema["probability"].dataType, ArrayType)
    scored = scored.withColumn(out, (F.col("probability") if plain else vector_to_array("probability"))[1])
    return scored.drop("probability", "rawPrediction", "prediction")


@dataclass(frozen=True)
class LearnerSize:
    """How much learning to buy; the small size is for tests and quick looks."""

    rounds: int = 20
    trees: int = 40
    depth: int = 5
    folds: int = 3
    fast: bool = False


@dataclass
class StackedModel:
    """Base learners, and a logistic blend over their probabilities and the features."""

    prepare: PipelineModel
    columns: list[str]
    bases: list[Transformer]
    blend: Transformer | None

    def score(self, frame: DataFrame, out: str = "prob_raw") -> DataFrame:
        keep = frame.columns
        scored = self.prepare.transform(frame)
        for i, base in enumerate(self.bases):
            scored = probability(scored, base, f"_p{i}")
        if self.blend is None:
            return scored.withColumn(out, F.col("_p0")).select(*keep, out)
        scored = _blend_features(len(self.bases)).transform(scored)
        return probability(scored, self.blend, out).select(*keep, out)


def _blend_features(n: int) -> VectorAssembler:
    return VectorAssembler(inputCols=[*[f"_p{i}" for i in range(n)], "features"], outputCol="_stack", handleInvalid="keep")


def _base_learners(seed: int, size: LearnerSize):
    return [
        boosted(seed, rounds=size.rounds, depth=size.depth),
        forest(seed, trees=size.trees, depth=size.depth),
        forest(seed + 1, trees=size.trees, depth=size.depth, subset="log2"),
    ]


def fit_stacked(train: DataFrame, columns: Sequence[str], seed: int = 42, size: LearnerSize = LearnerSize(), n_rows: int | None = None) -> StackedModel:
    """Out-of-fold base probabilities feed the blend, so it never sees a learner's own training rows.

    Folds come from a hash of the row's identity: the same row keeps its fold
    if a task is run again.  ``fast`` trains a single boosted model.
    """
    medians = lower_medians(train, columns, n_rows)
    columns = [c for c in columns if c in medians]
    prepare = Pipeline(stages=[fit_imputer(train, columns, medians), assemble(columns)]).fit(train)
    rows = prepare.transform(train).withColumn("future_direction", F.col("future_direction").cast("double"))
    rows = settle(rows.select("symbol", "datetime", "future_direction", "features"))
    learners = _base_learners(seed, size)
    if size.fast:
        return StackedModel(prepare, columns, [learners[0].fit(rows)], None)
    folded = rows.withColumn("_fold", F.pmod(F.xxhash64("symbol", "datetime"), F.lit(size.folds)))
    held_out = None
    for k in range(size.folds):
        rest, part = folded.where(F.col("_fold") != k), folded.where(F.col("_fold") == k)
        for i, learner in enumerate(learners):
            part = probability(part, learner.fit(rest), f"_p{i}")
        held_out = part if held_out is None else held_out.unionByName(part)
    # the fit passes over its rows more than once; written, they are scored once
    stacked = settle(_blend_features(len(learners)).transform(held_out).select("future_direction", "_stack"))
    blend = logistic("future_direction", "_stack").fit(stacked)
    return StackedModel(prepare, columns, [learner.fit(rows) for learner in learners], blend)


# ---------------------------------------------------------------- feature choice
def permutation_importance(
    model: StackedModel, rows: DataFrame, repeats: int = 2, buckets: int = 16, bucket_rows: int = 20_000
) -> DataFrame:
    """Loss of ROC-AUC when one feature is shuffled, for every feature in one pass.

    All rows count.  They swap values inside hash buckets of about ``bucket_rows`` rows (at least ``buckets`` of them), so no
    task orders more than these.  A row meets its partner once for all features; the vector with one value exchanged lives
    only while it is scored, and what is shuffled is a score per row and feature, counted together with equal ones first.
    """
    prepared = model.prepare.transform(rows).select("symbol", "datetime", "future_direction", vector_to_array("features").alias("_x"))
    prepared = settle(prepared)
    buckets = max(buckets, -(-prepared.count() // bucket_rows))
    prepared = prepared.withColumn("_bucket", F.pmod(F.xxhash64("symbol", "datetime"), F.lit(buckets)))
    names = F.array(*[F.lit(c) for c in model.columns])
    home = Window.partitionBy("_bucket").orderBy("symbol", "datetime")
    copies = prepared.select("future_direction", F.col("_x").alias("_v"), F.lit(-1).alias("_j"), F.lit(0).alias("_round"))
    for r in range(repeats):
        away = Window.partitionBy("_bucket").orderBy(F.xxhash64("symbol", "datetime", F.lit(r)))
        left = prepared.withColumn("_at", F.row_number().over(home))
        right = prepared.select("_bucket", F.row_number().over(away).alias("_at"), F.col("_x").alias("_other"))
        paired = left.join(right, ["_bucket", "_at"])
        swapped = paired.select(
            "future_direction", "_x", "_other", F.explode(F.sequence(F.lit(0), F.lit(len(model.columns) - 1))).alias("_j")
        ).select(
            "future_direction",
            F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.element_at("_other", i + 1)).otherwise(v)).alias("_v"),
            "_j",
            F.lit(r).alias("_round"),
        )
        copies = copies.unionByName(swapped)
    # a blend has to know how long the vectors are
    sized = VectorSizeHint(inputCol="features", size=len(model.columns), handleInvalid="optimistic")
    vectors = sized.transform(copies.withColumn("features", array_to_vector("_v")))
    for i, base in enumerate(model.bases):
        vectors = probability(vectors, base, f"_p{i}")
    if model.blend is None:
        scored = vectors.withColumn("prob_up", F.col("_p0"))
    else:
        scored = probability(_blend_features(len(model.bases)).transform(vectors), model.blend, "prob_up")
    auc = binary_metrics(scored, ["_j", "_round"], "future_direction", "prob_up").select("_j", "_round", "roc_auc")
    base_auc = F.max(F.when(F.col("_j") < 0, F.col("roc_auc"))).over(Window.partitionBy(F.lit(0)))  # one row per feature and repeat
    drops = auc.withColumn("_drop", base_auc - F.col("roc_auc")).where(F.col("_j") >= 0)
    table = drops.groupBy(F.element_at(names, F.col("_j") + 1).alias("feature")).agg(
        F.avg("_drop").alias("importance_mean"), F.stddev_pop("_drop").alias("importance_std")
    )
    table = table.withColumn("importance_abs", F.abs("importance_mean"))
    order = Window.orderBy(F.desc("importance_abs"), "feature")  # one row per feature
    return table.withColumn("rank", F.row_number().over(order))


def select_by_share(importance: DataFrame, share: float = IMPORTANCE_SHARE, min_features: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Positive importances, best first, up to a running share of their sum; at least ``min_features``."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per feature
    ordered = w.orderBy(F.desc("importance_mean"), "feature")
    positive = importance.where(F.col("importance_mean") > 0)
    return (
        positive.withColumns(
            {
                "cum_share": F.sum("importance_mean").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
                / F.sum("importance_mean").over(w),
                "place": F.row_number().over(ordered),
            }
        )
        .where((F.col("cum_share") <= share) | (F.col("place") <= min_features))
    )


def time_folds(frame: DataFrame, folds: int) -> DataFrame:
    """Column ``fold``: 0 .. folds by position in time, cut at dates; dates are weighted by their rows."""
    daily = frame.groupBy("datetime").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("datetime")  # one row per date
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    place = F.least(F.floor(before * (folds + 1) / total), F.lit(folds)).cast("int")
    cut = daily.select("datetime", place.alias("fold"), (F.row_number().over(w) - 1).alias("bar_index"))
    return frame.join(settle(cut), "datetime")


def stability_support(
    frame: DataFrame, columns: Sequence[str], top_n: int, folds: int = 4, size: LearnerSize = LearnerSize(), min_rows: int = 0
) -> DataFrame:
    """Share of contexts (expanding time folds, calm and wild halves) in which a feature is among the best.

    Contexts of fewer than ``min_rows`` rows or of one class have no vote.
    """
    columns = list(columns)
    rows = time_folds(impute(frame, columns).withColumn("future_direction", F.col("future_direction").cast("double")), folds)
    rows = settle(assemble(columns).transform(rows))
    contexts = [F.col("fold") < k for k in range(1, folds + 1)]
    regime = next((c for c in ("market_volatility_20", "volatility_20") if c in columns), None)
    if regime:
        middle = sum(middles(rows, [regime]).get(regime, (math.nan, math.nan))) / 2.0
        contexts += [F.col(regime) <= middle, F.col(regime) > middle]
    votes = {c: 0 for c in columns}
    used = 0
    for i, cond in enumerate(contexts):
        part = rows.where(cond)
        n, low, high = part.agg(F.count(F.lit(1)), F.min("future_direction"), F.max("future_direction")).first()
        if n < min_rows or low is None or low == high:
            continue
        weights = forest(42 + i, trees=size.trees, depth=size.depth).fit(part).featureImportances.toArray()
        for j in sorted(range(len(columns)), key=lambda j: -weights[j])[:top_n]:
            votes[columns[j]] += weights[j] > 0
        used += 1
    table = [(c, int(n), used, float(n / used) if used else 0.0) for c, n in votes.items()]
    return frame.sparkSession.createDataFrame(table, "feature string, votes int, contexts int, support double")


@dataclass(frozen=True)
class SelectionConfig:
    """Bounds of the nested selection."""

    min_features: int = 25
    max_features: int = 260
    min_rows: int = 350
    min_validation_rows: int = 80
    validation_share: float = 0.2
    folds: int = 4
    top_share: float = 0.35
    min_contexts: int = 2


@dataclass(frozen=True)
class Selection:
    """Chosen features in their given order, and how many each step left out."""

    columns: list[str]
    counts: dict[str, int]


def _by_importance(train: DataFrame, columns: list[str], config: SelectionConfig, size: LearnerSize) -> tuple[list[str], list[str]] | None:
    """Features with the largest share of the validation AUC, and all by importance; None where rows or classes are too few."""
    cut = date_at_share(train, 1.0 - config.validation_share)
    if cut is None:
        return None
    fit, rest = train.where(F.col("datetime") < F.lit(cut)), train.where(F.col("datetime") >= F.lit(cut))
    if rest.limit(config.min_validation_rows).count() < config.min_validation_rows or not _two_classes(fit) or not _two_classes(rest):
        return None
    prepare = Pipeline(stages=[fit_imputer(fit, columns), assemble(columns)]).fit(fit)
    rows = prepare.transform(fit).withColumn("future_direction", F.col("future_direction").cast("double"))
    judge = StackedModel(prepare, columns, [forest(42, trees=size.trees, depth=size.depth).fit(rows)], None)
    table = settle(permutation_importance(judge, rest))
    ranked = [r.feature for r in table.orderBy("rank").collect()]  # one row per feature
    kept = [r.feature for r in select_by_share(table, IMPORTANCE_SHARE, max(1, config.min_features)).orderBy("place").collect()]
    return (kept or ranked[: max(config.min_features, min(config.max_features, len(ranked)))]), ranked


def select_features(train: DataFrame, columns: Sequence[str], config: SelectionConfig = SelectionConfig(), size: LearnerSize = LearnerSize()) -> Selection:
    """Missing, constant and correlated columns go first; importance on later rows and votes of contexts choose among the rest.

    A feature must be among the best in at least ``MIN_SUPPORT`` of the contexts.  Fewer than ``min_features`` are filled up
    by support, then importance; more than ``max_features`` are cut.  Features with equal support keep their given order.
    """
    columns = list(columns)
    quality = {r.feature: r for r in column_quality(train, columns).collect()}  # one row per feature
    full = [c for c in columns if quality[c].missing_rate is not None and quality[c].missing_rate <= MAX_MISSING]
    varied = [c for c in full if quality[c].varies]
    left = uncorrelated_columns(train, varied) if varied else []
    counts = {
        "raw_features": len(columns),
        "dropped_missing": len(columns) - len(full),
        "dropped_constant": len(full) - len(varied),
        "dropped_correlated": len(varied) - len(left),
        "prefilter_features": len(left),
        "dropped_unstable": 0,
        "stability_contexts": 0,
    }
    chosen, ranked = list(left), list(left)
    rows = train.count()
    if left and _two_classes(train):
        if rows >= config.min_rows and len(left) > config.min_features:
            found = _by_importance(train, left, config, size)
            chosen, ranked = found if found else (chosen, ranked)
        if rows >= max(120, 2 * config.min_validation_rows):
            top = max(config.min_features, min(config.max_features, round(len(left) * config.top_share)))
            votes = stability_support(train, left, top, config.folds, size, max(100, config.min_validation_rows)).collect()
            support = {r.feature: r.support for r in votes}
            counts["stability_contexts"] = votes[0].contexts
            stable = {c for c in left if support[c] >= MIN_SUPPORT}
            if votes[0].contexts >= config.min_contexts and stable:
                before = len(chosen)
                chosen = [c for c in chosen if c in stable]
                counts["dropped_unstable"] = before - len(chosen)
                for c in [*sorted(left, key=lambda c: -support[c]), *ranked]:
                    if len(chosen) >= config.min_features:
                        break
                    if c not in chosen:
                        chosen.append(c)
    chosen = chosen[: config.max_features] if config.max_features > 0 else chosen
    if len(chosen) < config.min_features:
        chosen = left[: config.min_features]
    chosen = [c for c in left if c in set(chosen)]
    counts |= {"selected_features": len(chosen), "dropped_low_importance": len(left) - len(chosen)}
    return Selection(chosen, counts)


# ---------------------------------------------------------------- calibration and filters
def clipped(prob: Column) -> Column:
    return clip(prob, PROB_FLOOR, 1.0 - PROB_FLOOR)


def logit(prob: Column) -> Column:
    p = clipped(prob)
    return F.ln(p / (1.0 - p))


@dataclass(frozen=True)
class Calibration:
    coef: float = 1.0
    intercept: float = 0.0
    fitted: bool = False

    def apply(self, prob: Column) -> Column:
        """Calibrated probability as a plain column expression."""
        if not self.fitted:
            return clipped(prob)
        return clipped(1.0 / (1.0 + F.exp(-(self.coef * logit(prob) + self.intercept))))


def fit_calibration(rows: DataFrame, prob: str = "prob_raw", label: str = "future_direction") -> Calibration:
    """Logistic curve on the log-odds; left out when rows are few or one class is missing."""
    known = rows.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    n, low, high = known.agg(F.count(F.lit(1)), F.min(label), F.max(label)).first()
    if n < MIN_PLATT_ROWS or low == high:
        return Calibration()
    points = known.select(F.col(label).cast("double").alias("_y"), logit(F.col(prob)).alias("_z"))
    model = LogisticRegression(labelCol="_y", featuresCol="_f", maxIter=100).fit(assemble(["_z"], "_f").transform(points))
    return Calibration(float(model.coefficients[0]), float(model.intercept), True)


def meta_columns(frame: DataFrame) -> DataFrame:
    """Confidence columns of the meta filter; needs pred_prob_up and position."""
    p, side = F.col("pred_prob_up"), F.col("position")
    return frame.withColumns(
        {
            "meta_prob_up": p,
            "meta_abs_edge": F.abs(p - 0.5),
            "meta_side": side.cast("double"),
            "meta_signed_edge": F.when(side >= 0, p - 0.5).otherwise(0.5 - p),
        }
    )


META_COLUMNS = ("meta_prob_up", "meta_abs_edge", "meta_side", "meta_signed_edge")


@dataclass
class MetaFilter:
    """Second opinion on active signals: keep those likely to end above their cost."""

    prepare: PipelineModel
    model: Transformer
    threshold: float = 0.55

    def apply(self, frame: DataFrame) -> DataFrame:
        keep = frame.columns
        scored = probability(self.prepare.transform(meta_columns(frame)), self.model, "_meta")
        active = F.col("position") != 0
        level = min(max(self.threshold, META_LOW), META_HIGH)
        kept = F.when(active & (F.col("_meta") < level), 0).otherwise(F.col("position"))
        return scored.select(
            *[c for c in keep if c != "position"], kept.alias("position"), F.when(active, F.col("_meta")).alias("meta_prob_trade")
        )


def fit_meta_filter(rows: DataFrame, columns: Sequence[str], costs: Costs, threshold: float = 0.55) -> MetaFilter | None:
    """Balanced logistic on features and confidence; None when trades or either class are too few."""
    net = F.col("position") * F.col("future_return") - costs.per_trade
    active = meta_columns(rows.where((F.col("position") != 0) & F.col("future_return").isNotNull())).withColumn("_won", (net > 0).cast("double"))
    n, wins = active.agg(F.count(F.lit(1)), F.coalesce(F.sum("_won"), F.lit(0.0))).first()
    if n < META_MIN_TRADES or min(wins, n - wins) < META_MIN_CLASS:
        return None
    weight = F.when(F.col("_won") == 1, n / (2.0 * wins)).otherwise(n / (2.0 * (n - wins)))
    names = [*columns, *META_COLUMNS]
    prepare = Pipeline(stages=[fit_imputer(active, names), assemble(names)]).fit(active)
    fitted = logistic("_won", "features", "_weight").fit(prepare.transform(active.withColumn("_weight", weight)))
    return MetaFilter(prepare, fitted, threshold)


# ---------------------------------------------------------------- scores
def binary_metrics(
    scored: DataFrame, keys: Sequence[str], label: str, prob: str, cut: float = 0.5, slices: int = 32, slice_rows: int = 500_000
) -> DataFrame:
    """accuracy, precision, recall, f1, roc_auc per key.

    Rows with one score are counted together first.  The distinct scores of a
    key are then cut into ``slices`` value ranges, or as many as keep a range at
    about ``slice_rows`` scores, each ranked on its own and put behind the
    counts of the lower ones, so no key lands whole in a task (approximate
    quantiles only place the cuts, the ranks stay exact).  Keys stand for
    patterns, folds or models: what there is one of per key and range is sent
    to the scores, which are shuffled by key and range only.
    """
    keys = list(keys)
    y, p = F.col(label).cast("double"), F.col(prob)
    levels = scored.where(y.isNotNull() & p.isNotNull()).groupBy(*keys, p.cast("double").alias("_level")).agg(
        F.sum(y).alias("_pos"),
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.sum((p >= cut).cast("double")).alias("_up"),
        F.sum(((p >= cut) & (y == 1)).cast("double")).alias("_hit"),
    )
    levels = settle(levels.withColumn("_one", F.lit(0)))
    by = [*keys, "_one"]
    widest = levels.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    slices = max(slices, -(-widest // slice_rows))
    steps = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = levels.groupBy(*by).agg(F.percentile_approx("_level", steps, F.lit(max(2000, 20 * slices))).alias("_cuts"))
    sliced = levels.join(F.broadcast(cuts), by).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_level")))).drop("_cuts")
    lost = F.col("_n") - F.col("_pos")
    lower = sliced.groupBy(*by, "_slice").agg(F.sum(lost).alias("_in"))
    lower = lower.withColumn("_before", F.sum("_in").over(Window.partitionBy(*by).orderBy("_slice")) - F.col("_in")).drop("_in")
    inside = Window.partitionBy(*by, "_slice").orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("_under", F.coalesce(F.sum(lost).over(inside), F.lit(0.0))).join(F.broadcast(lower), [*by, "_slice"])
    won = F.col("_pos") * (F.col("_before") + F.col("_under") + lost / 2.0)
    totals = ranked.withColumn("_won", won).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("_pos", "_n", "_up", "_hit", "_won")]
    )
    n, pos, up, hit = (F.col(c) for c in ("_n", "_pos", "_up", "_hit"))
    precision, recall = F.coalesce(ratio(hit, up), F.lit(0.0)), F.coalesce(ratio(hit, pos), F.lit(0.0))
    return totals.select(
        *keys,
        n.cast("bigint").alias("rows"),
        ((hit + (n - up - (pos - hit))) / n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(ratio(2.0 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        ratio(F.col("_won"), pos * (n - pos)).alias("roc_auc"),
    )


def net_objective(trades: DataFrame, keys: Sequence[str], value: str = "strategy_return", interval: str = "1d") -> DataFrame:
    """Compounded return, sharpe, win rate, -|drawdown| and -log(1 + trades), in trade order.

    The drawdown of a long trade list is put together from dates: each date is
    walked on its own, then the dates are chained.
    """
    keys = list(keys)
    r = F.col(value)
    rows = trades.where(r.isNotNull())
    inside = Window.partitionBy(*keys, "datetime").orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)
    walked = rows.withColumn("_s", F.sum(log_growth(r)).over(inside)).withColumn("_fall", F.col("_s") - F.max("_s").over(inside))
    daily = walked.groupBy(*keys, "datetime").agg(
        F.min("_fall").alias("_fall"), F.min("_s").alias("_low"), F.max("_s").alias("_high"), F.sum(log_growth(r)).alias("_total")
    )
    days = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("datetime")
    start = F.sum("_total").over(days.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")
    chained = daily.withColumn("_start", start)
    peak = F.max(F.col("_start") + F.col("_high")).over(days.rowsBetween(Window.unboundedPreceding, -1))
    falls = chained.withColumn("_worst", F.least(F.col("_fall"), F.col("_start") + F.col("_low") - peak))
    worst = falls.groupBy(*keys).agg(F.expm1(F.min("_worst")).alias("_dd"))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.expm1(F.sum(log_growth(r))).alias("cumulative_return"),
        sharpe(r, periods_per_year(interval)).alias("sharpe"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
    )
    joined = stats.join(worst, keys) if keys else stats.crossJoin(worst)
    return joined.select(
        *keys,
        "trades",
        "cumulative_return",
        "sharpe",
        "win_rate",
        (-F.abs("_dd")).alias("drawdown_score"),
        (-F.log1p("trades")).alias("trade_penalty"),
    )


# ---------------------------------------------------------------- training
@dataclass(frozen=True)
class TrainConfig:
    min_rows: int = 100
    seeds: tuple[int, ...] = (42,)
    size: LearnerSize = field(default_factory=LearnerSize)
    costs: Costs = field(default_factory=Costs)
    horizon: int = 1
    embargo_bars: int = 0
    meta_filter: bool = True
    #: Newest rows that one fit sees at most (None: all); test rows are never cut.
    max_rows: int | None = None
    #: None keeps every usable, uncorrelated column.
    selection: SelectionConfig | None = None


def date_at_share(frame: DataFrame, share: float):
    """First date at which the running share of rows reaches ``share`` (dates never straddle)."""
    daily = frame.groupBy("datetime").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("datetime")  # one row per date
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return daily.withColumn("_share", before / total).where(F.col("_share") >= share).agg(F.min("datetime")).first()[0]


def _two_classes(frame: DataFrame) -> bool:
    low, high = frame.agg(F.min("future_direction"), F.max("future_direction")).first()
    return low is not None and low != high


@dataclass
class FittedPattern:
    """One trained pattern: scored test rows, facts, and the parts that score further rows."""

    scored: DataFrame
    facts: dict
    model: StackedModel
    calibration: Calibration
    meta: MetaFilter | None
    counts: dict[str, int]


@dataclass
class PatternModel:
    """A fitted model with its calibration, and the later training rows, scored, on which thresholds are tuned."""

    columns: list[str]
    counts: dict[str, int]
    model: StackedModel
    calibration: Calibration
    held: DataFrame
    held_rows: int


@dataclass
class _Parts:
    """Chosen features, and the rows to fit and to calibrate on."""

    columns: list[str]
    counts: dict[str, int]
    fit: DataFrame
    fit_rows: int
    rest: DataFrame
    rest_rows: int


def _cut(train: DataFrame):
    """One row: rows and classes, the date at which the running share reaches ``FIT_SHARE``, rows from it on, rows and classes before."""
    label = F.col("future_direction")
    daily = train.groupBy("datetime").agg(F.count(F.lit(1)).alias("_n"), F.min(label).alias("_low"), F.max(label).alias("_high"))
    w = Window.orderBy("datetime")  # one row per date
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    late, dated = F.col("_share") >= FIT_SHARE, F.col("datetime").isNotNull()
    return daily.withColumn("_share", before / total).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.min("_low").alias("low"),
        F.max("_high").alias("high"),
        F.min(F.when(late, F.col("datetime"))).alias("cut"),
        F.coalesce(F.sum(F.when(late & dated, F.col("_n"))), F.lit(0)).alias("n_rest"),
        F.coalesce(F.sum(F.when(~late & dated, F.col("_n"))), F.lit(0)).alias("n_fit"),
        F.min(F.when(~late & dated, F.col("_low"))).alias("fit_low"),
        F.max(F.when(~late & dated, F.col("_high"))).alias("fit_high"),
    ).first()


def _choose(train: DataFrame, test: DataFrame, columns: Sequence[str], config: TrainConfig, judge_test: bool) -> _Parts | str:
    at = _cut(train)
    if at.n < config.min_rows:
        return f"fewer than {config.min_rows} training rows"
    if at.low is None or at.low == at.high:
        return "one class in the training rows"
    if judge_test and not _two_classes(test):
        return "one class or no row in the test rows"
    if config.selection:
        picked = select_features(train, columns, config.selection, config.size)
        chosen, counts = picked.columns, picked.counts
    else:
        usable = usable_columns(train, columns)
        chosen = uncorrelated_columns(train, usable, rows=at.n)
        counts = {"raw_features": len(columns), "prefilter_features": len(chosen), "selected_features": len(chosen), "dropped_correlated": len(usable) - len(chosen)}
    if not chosen:
        return "no usable feature"
    if at.cut is None or at.n_rest < MIN_CALIBRATION_ROWS or at.fit_low is None or at.fit_low == at.fit_high:
        return _Parts(chosen, counts, train, at.n, train.limit(0), 0)
    date = F.col("datetime")
    return _Parts(chosen, counts, train.where(date < F.lit(at.cut)), at.n_fit, train.where(date >= F.lit(at.cut)), at.n_rest)


def _fit_parts(parts: _Parts, seed: int, size: LearnerSize) -> PatternModel:
    model = fit_stacked(parts.fit, parts.columns, seed, size, parts.fit_rows)
    held = settle(model.score(parts.rest))
    calibration = fit_calibration(held)
    return PatternModel(parts.columns, parts.counts, model, calibration, held.withColumn("pred_prob_up", calibration.apply(F.col("prob_raw"))), parts.rest_rows)


def fit_model(train: DataFrame, test: DataFrame, columns: Sequence[str], config: TrainConfig, judge_test: bool = True) -> PatternModel | str:
    """Select, fit and calibrate one model on written rows, with the first seed; or why there is none."""
    parts = _choose(train, test, columns, config, judge_test)
    return parts if isinstance(parts, str) else _fit_parts(parts, config.seeds[0], config.size)


def tune(held: DataFrame, keys: Sequence[str], rows: Column, costs: Costs) -> DataFrame:
    """Best thresholds per key; ``rows``, one of the keys or a constant, is how many rows a key has."""
    share = lambda part, least: F.greatest(F.lit(least), F.floor(rows * part))
    return th.optimize_validation(
        held, list(keys), costs, "future_excess_return",
        min_trades=share(0.05, 10), min_side=share(0.01, 4), exposure_penalty=0.40, imbalance_penalty=0.25,
    )


def fit_pattern(train: DataFrame, test: DataFrame, columns: Sequence[str], config: TrainConfig, judge_test: bool = True) -> FittedPattern | str:
    """Select, fit, calibrate, tune and filter one model; or why there is none.  Without ``judge_test`` one class in the test rows is enough."""
    train, test = settle(train), settle(test)
    parts = _choose(train, test, columns, config, judge_test)
    if isinstance(parts, str):
        return parts
    best = None
    for seed in config.seeds:
        found = _fit_parts(parts, seed, config.size)
        model, calibration, held = found.model, found.calibration, found.held
        tuned = tune(held.withColumn("_k", F.lit("model")), ["_k"], F.lit(found.held_rows), config.costs).first() if found.held_rows else None
        long_at, short_at = (tuned.long_threshold, tuned.short_threshold) if tuned else DEFAULT_PAIR
        side = position(F.col("pred_prob_up"), F.lit(long_at), F.lit(short_at))
        scored = model.score(test).withColumn("pred_prob_up", calibration.apply(F.col("prob_raw"))).withColumn("position", side)
        meta = fit_meta_filter(held.withColumn("position", side), parts.columns, config.costs) if config.meta_filter else None
        scored = meta.apply(scored) if meta else scored.withColumn("meta_prob_trade", F.lit(None).cast("double"))
        scored = settle(scored)
        facts = {"seed": seed, "long_threshold": long_at, "short_threshold": short_at, "features": len(parts.columns), "meta_filter": meta is not None}
        fitted = FittedPattern(scored, facts, model, calibration, meta, parts.counts)
        if len(config.seeds) == 1:  # nothing to choose among
            return fitted
        traded = scored.where((F.col("position") != 0) & F.col("future_return").isNotNull()).withColumn(
            "strategy_return", F.col("position") * F.col("future_return") - config.costs.per_trade
        )
        goal = net_objective(traded, [], interval=config.costs.interval).first()
        rank = (-1e12,) if goal is None or not goal.trades else (
            goal.cumulative_return, goal.sharpe, goal.win_rate, goal.drawdown_score, goal.trade_penalty
        )
        if best is None or rank > best[0]:
            best = (rank, fitted)
    return best[1]


def add_training_label_end(frame: DataFrame, config: TrainConfig) -> DataFrame:
    return lb.add_label_end(frame, config.horizon + max(0, config.costs.latency) + max(0, config.embargo_bars))


def _skip_row(frame: DataFrame, name: str, config: TrainConfig, why: str) -> DataFrame:
    """The one row of a pattern without a model: its names and the reason, all else NULL."""
    kinds = {c: frame.schema[c].dataType for c in ("symbol", "datetime", "future_direction", "future_return")}
    kinds |= {"prob_raw": "double", "pred_prob_up": "double", "position": "int", "meta_prob_trade": "double"}
    kinds |= {"seed": "int", "long_threshold": "double", "short_threshold": "double", "features": "int", "meta_filter": "boolean"}
    return frame.sparkSession.range(1).select(
        F.lit(name).alias("pattern"),
        F.lit(f"{name}_h{config.horizon}").alias("model_file"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()],
        F.lit(why).alias("skipped_because"),
    )


def newest(train: DataFrame, rows: int | None) -> DataFrame:
    return train.orderBy(F.desc("datetime"), "symbol").limit(rows) if rows else train


def training_parts(dataset: DataFrame, patterns: Sequence[str], config: TrainConfig):
    """``(pattern, unpurged training rows, training rows, test rows, start of the test part)`` of each pattern."""
    frame = add_training_label_end(dataset, config)
    test = F.col("split") == "test"
    start = frame.where(test).agg(F.min("datetime")).first()[0]
    for name in patterns:
        rows = pt.pattern_subset(frame, name)
        raw = rows.where(F.col("split") == "train")
        train = newest(lb.purge(raw, F.lit(start)), config.max_rows)
        yield name, raw, train, rows.where(test), start


def train_patterns(dataset: DataFrame, columns: Sequence[str], patterns: Sequence[str], config: TrainConfig = TrainConfig()) -> DataFrame:
    """Train one model per pattern and return the scored test rows of all of them as one signal table.

    Labels end ``horizon + latency + embargo_bars`` bars on, so an embargo purges more.
    A pattern without a model has one row that says why in ``skipped_because``.
    """
    out = None
    for name, _, train, test, _ in training_parts(dataset, patterns, config):
        fitted = fit_pattern(train, test, columns, config)
        if isinstance(fitted, str):
            blank = _skip_row(dataset, name, config, fitted)
            out = blank if out is None else out.unionByName(blank)
            continue
        tagged = fitted.scored.select(
            F.lit(name).alias("pattern"),
            F.lit(f"{name}_h{config.horizon}").alias("model_file"),
            "symbol",
            "datetime",
            "future_direction",
            "future_return",
            "prob_raw",
            "pred_prob_up",
            "position",
            "meta_prob_trade",
            *[F.lit(v).alias(k) for k, v in fitted.facts.items()],
            F.lit(None).cast("string").alias("skipped_because"),
        )
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no pattern was asked for")
    return out


def purged_cv(frame: DataFrame, columns: Sequence[str], folds: int = 3, purge_bars: int = 1, size: LearnerSize = LearnerSize(fast=True)) -> DataFrame:
    """ROC-AUC per expanding time fold; training rows within ``purge_bars`` dates of the test part are dropped."""
    rows = settle(time_folds(frame, folds))
    spark = frame.sparkSession
    out = spark.createDataFrame([], "fold int, rows bigint, roc_auc double, skipped_because string")

    def skipped(fold, n, why):
        return out.unionByName(spark.createDataFrame([(fold, n, None, why)], out.schema))

    if rows.limit(CV_MIN_ROWS).count() < CV_MIN_ROWS:
        return skipped(None, rows.count(), f"fewer than {CV_MIN_ROWS} rows")
    for k in range(1, folds + 1):
        test = rows.where(F.col("fold") == k)
        first = test.agg(F.min("bar_index")).first()[0]
        if first is None:
            out = skipped(k, 0, "no test row")
            continue
        train = rows.where(F.col("bar_index") < first - purge_bars)
        if train.limit(CV_MIN_TRAIN).count() < CV_MIN_TRAIN:
            out = skipped(k, test.count(), f"fewer than {CV_MIN_TRAIN} training rows")
            continue
        if not _two_classes(train) or not _two_classes(test):
            out = skipped(k, test.count(), "one class in a part")
            continue
        scored = fit_stacked(train, columns, 42, size).score(test)
        part = binary_metrics(scored, ["fold"], "future_direction", "prob_raw").select("fold", "rows", "roc_auc", F.lit(None).cast("string").alias("skipped_because"))
        out = out.unionByName(part)
    return out
