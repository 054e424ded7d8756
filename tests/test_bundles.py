"""Saved models: round trips, eligibility of rows, meta filters, scans, nested selection."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barweave.operators import bundles as mb, learn as ml, patterns as pt, signals as sg

T0 = dt.datetime(2024, 1, 1)
SMALL = ml.LearnerSize(rounds=2, trees=3, depth=2, folds=2)


def model_rows(spark, n=420):
    """Two symbols, all rows a doji, a label that follows x1, a twin of x1, noise, and a column that is mostly missing."""
    rows = []
    for i in range(n):
        for s in ("A", "B"):
            x = math.sin(i * 12.9898 + ord(s)) * 43758.5453 % 1
            noise = math.sin(i * 78.233 + ord(s) * 3) * 12543.123 % 1
            y = int(x + 0.35 * (noise - 0.5) > 0.5)
            rows.append((s, T0 + dt.timedelta(days=i), 10.0 + x, x, 3 * x + 1, noise, noise if i % 10 == 0 else None, y, (0.02 if y else -0.02), (0.02 if y else -0.02), 1, "doji", "test" if i >= 340 else "train"))
    flags = {pt.pattern_column(p): F.lit(0) for p in pt.PATTERNS if p != "doji"}
    names = "symbol string, datetime timestamp, close double, x1 double, twin double, noise double, rare double, future_direction int, future_return double, future_excess_return double, pattern_doji int, pattern string, split string"
    return spark.createDataFrame(rows, names).withColumns(flags)


COLUMNS = ["x1", "twin", "noise", "rare"]


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bundles"))
    frame = model_rows(spark)
    config = ml.TrainConfig(size=SMALL, selection=ml.SelectionConfig(min_features=1, max_features=3, min_rows=100, min_validation_rows=40, folds=2))
    table = mb.train_bundles(frame, COLUMNS, ["doji", "hammer"], folder, config, name="t", cv_folds=2)
    return folder, frame, config, {r.pattern: r for r in table.collect()}


def test_training_summary_row(trained):
    _, _, _, rows = trained
    doji, hammer = rows["doji"], rows["hammer"]
    assert hammer.skipped_because.startswith("fewer than") and hammer.model_file is None
    assert (doji.train_rows, doji.test_rows, doji.purged_train_rows) == (2 * 339, 2 * 80, 2) and doji.skipped_because is None
    assert doji.train_end == T0 + dt.timedelta(days=338) and doji.test_start == T0 + dt.timedelta(days=340)
    assert doji.roc_auc > 0.8 and doji.cv_roc_auc > 0.7 and 0 < doji.positive_rate_test < 1
    counts = doji.counts
    assert (counts["raw_features"], counts["dropped_missing"], counts["dropped_constant"], counts["dropped_correlated"]) == (4, 1, 0, 1)
    assert counts["prefilter_features"] == 2 and counts["stability_contexts"] == 2 and doji["columns"] == ["x1"]
    assert counts["selected_features"] + counts["dropped_low_importance"] == 2


def test_scores_survive_the_round_trip(spark, trained):
    folder, frame, config, _ = trained
    (loaded,) = mb.load_bundles(spark, folder, "1d", 1)
    parts = {name: (train, test) for name, _, train, test, _ in ml.training_parts(frame, ["doji"], config)}
    fitted = ml.fit_pattern(*parts["doji"], COLUMNS, config)
    again = {(r.symbol, r.datetime): (r.pred_prob_up, r.position, r.meta_prob_trade) for r in loaded.judge(parts["doji"][1], use_model=True).collect()}
    first = {(r.symbol, r.datetime): (r.pred_prob_up, r.position, r.meta_prob_trade) for r in fitted.scored.collect()}
    assert again == first and len(first) == 160
    assert (loaded.long_threshold, loaded.short_threshold) == (fitted.facts["long_threshold"], fitted.facts["short_threshold"])
    missing = loaded.judge(parts["doji"][1].drop("x1"), use_model=True)
    assert missing.count() == 160 and "x1" not in missing.columns


def test_the_catalog_lists_whole_bundles_only(spark, trained, tmp_path):
    folder, *_ = trained
    assert [r.model_file for r in mb.catalog(spark, folder).collect()] == ["doji__1d__h1__t"]
    assert mb.catalog(spark, str(tmp_path / "nothing")).count() == 0
    assert mb.load_bundles(spark, folder, "1h", 1) == [] and mb.load_bundles(spark, folder, "1d", 2) == []
    assert mb.load_bundles(spark, folder, "1d", 1, patterns=["hammer"]) == []
    own = str(tmp_path / "b")
    for level in (0.6, 0.7):  # the second takes the place of the first
        mb.save_bundle(spark, mb.rule_bundle("doji", "x1", long_threshold=level), own)
    assert [(r.model_file, r.long_threshold) for r in mb.catalog(spark, own).collect()] == [("doji__1d__h1", 0.7)]


def bars_with(spark, closes, split_at, probs, pattern="doji"):
    rows = [("A", T0 + dt.timedelta(days=i), float(c), p, int(pattern == "doji"), pattern if pattern == "doji" else None, "train" if i < split_at else "test") for i, (c, p) in enumerate(zip(closes, probs))]
    flags = {pt.pattern_column(p): F.lit(0) for p in pt.PATTERNS if p != "doji"}
    return spark.createDataFrame(rows, "symbol string, datetime timestamp, close double, prob double, pattern_doji int, pattern string, split string").withColumns(flags)


def day(n):
    return T0 + dt.timedelta(days=n)


@pytest.mark.parametrize(
    "end, start, embargo, first",
    [(day(4), None, 0, 4), (day(4), day(6), 0, 6), (day(4), day(6), 1, 7), (None, None, 0, 2), (None, None, 1, 3), (day(50), None, 0, 3)],
)
def test_models_are_judged_after_their_training(spark, tmp_path, end, start, embargo, first):
    """No date: the last training date of the dataset; nothing that late: the test rows."""
    frame = bars_with(spark, range(10, 20), 3, [0.9] * 10)
    mb.save_bundle(spark, mb.rule_bundle("doji", "prob", train_end=end, test_start=start), str(tmp_path))
    out = mb.backtest_saved_models(frame, str(tmp_path), embargo_bars=embargo)
    assert sorted(r.datetime for r in out.trades.collect()) == [day(i) for i in range(first, 9)]  # the last bar has no exit
    row = out.summary.first()
    assert (row.backtest_start, row.backtest_end, row.trades) == (day(first), day(9), 9 - first)
    got = {(r.curve_variant, r.datetime) for r in out.curves().collect()}
    assert {v for v, _ in got} == {"ml_model", "baseline_blind_pattern", "baseline_universe_eqw"} and len(got) == 3 * (9 - first)


def test_pool_joins_by_pattern(spark, tmp_path):
    frame = bars_with(spark, range(10, 20), 3, [0.9] * 10)
    models = spark.createDataFrame([("m", "doji", None, None), ("n", "hammer", None, None)], "model_file string, pattern string, train_end timestamp, test_start timestamp")
    pool = sg.out_of_sample(pt.fan_out(frame).drop("pattern"), models, "1d", 0, frame)
    plan = pool._jdf.queryExecution().optimizedPlan().toString()
    assert {r.model_file for r in pool.collect()} == {"m"} and "member" in plan.split("Join Inner", 1)[1].split("\n")[0]


def test_thresholds_and_meta_filter(spark, tmp_path):
    frame = bars_with(spark, range(10, 20), 0, [0.9, 0.62, 0.5, 0.38, 0.1] * 2)
    bundle = mb.rule_bundle("doji", "prob", long_threshold=0.6, short_threshold=0.4, meta_probability="0.4 + meta_abs_edge", meta_threshold=0.2)
    mb.save_bundle(spark, bundle, str(tmp_path))
    (loaded,) = mb.load_bundles(spark, str(tmp_path), "1d", 1)
    assert loaded.thresholds(None, 0.3) == (0.6, 0.3) and loaded.thresholds(0.7, 0.3, True) == (0.6, 0.4)
    got = [(r.position, r.meta_prob_trade and round(r.meta_prob_trade, 6)) for r in loaded.judge(frame).orderBy("datetime").limit(5).collect()]
    # a level below one half counts as one half
    assert got == [(1, 0.8), (1, 0.52), (0, None), (-1, 0.52), (-1, 0.8)]
    loaded.meta.threshold = 0.6
    assert [r.position for r in loaded.judge(frame).orderBy("datetime").limit(5).collect()] == [1, 0, 0, 0, -1]


def test_scan_takes_the_best_model_of_a_symbol(spark, tmp_path):
    frame = bars_with(spark, range(10, 14), 0, [0.2, 0.2, 0.2, 0.7])
    other = bars_with(spark, range(10, 14), 0, [0.2, 0.2, 0.2, 0.45], pattern="none").withColumn("symbol", F.lit("B"))
    both = frame.unionByName(other)
    for name, auc, curve in (("low", 0.5, ml.Calibration()), ("high", 0.6, ml.Calibration()), ("flat", 0.9, ml.Calibration(0.0, 0.0, True))):
        mb.save_bundle(spark, mb.rule_bundle("doji", "prob", curve, name=name, roc_auc=auc), str(tmp_path))
    mb.save_bundle(spark, mb.rule_bundle("none", "prob", short_threshold=0.46, name="n"), str(tmp_path))
    got = {r.symbol: r for r in mb.scan_saved_models(both, str(tmp_path)).collect()}
    assert (got["A"].model_file, got["A"].signal, got["A"].prob_up) == ("doji__1d__h1__high", "up", 0.7)
    assert (got["B"].model_file, got["B"].signal) == ("none__1d__h1__n", "down")
    assert mb.scan_saved_models(both, str(tmp_path), model_files=["doji__1d__h1__flat"]).count() == 0
    assert mb.scan_saved_models(both, str(tmp_path), horizon=5).count() == 0
    with pytest.raises(ValueError):
        mb.backtest_saved_models(both, str(tmp_path / "none"))


def test_meta_filters_look_at_the_side(spark, tmp_path):
    frame = bars_with(spark, range(10, 20), 0, [0.9, 0.62, 0.5, 0.38, 0.1] * 2)
    mb.save_bundle(spark, mb.rule_bundle("doji", "prob", meta_probability="0.5 + meta_signed_edge", meta_threshold=0.6), str(tmp_path))
    (loaded,) = mb.load_bundles(spark, str(tmp_path), "1d", 1)
    got = [(r.may_buy, r.may_sell) for r in loaded.both_sides(frame).orderBy("datetime").limit(5).collect()]
    assert got == [(True, False), (True, False), (False, False), (False, True), (False, True)]


def test_thresholds_are_searched_behind_the_meta_filter(spark, tmp_path):
    """The filter lets through only rows far from one half, so every pair that trades these alone is equal and the lowest thresholds win."""
    probs = [0.9 if i % 2 else 0.6 for i in range(40)]
    closes = [100.0 + (i // 2) for i in range(40)]  # a row of 0.9 gains, one of 0.6 stands still
    frame = bars_with(spark, closes, 1, probs)
    for name, meta in (("plain", None), ("strict", "0.5 + meta_abs_edge")):
        mb.save_bundle(spark, mb.rule_bundle("doji", "prob", meta_probability=meta, meta_threshold=0.8, name=name), str(tmp_path))
    got = {r.model_file: r for r in mb.optimize_saved_models(frame, str(tmp_path), sg.Costs(), min_trades=5).collect()}
    plain, strict = got["doji__1d__h1__plain"], got["doji__1d__h1__strict"]
    assert plain.long_threshold > 0.6 and plain.improvement_cumulative_return > 0
    assert strict.long_threshold < 0.6 and abs(strict.improvement_cumulative_return) < 1e-12
    assert plain.trades == strict.trades and abs(plain.cumulative_return - strict.cumulative_return) < 1e-9


def test_importance_equals_one_feature_at_a_time(spark, trained):
    """Each feature is exchanged and scored alone, with partners taken in the order that the operator states."""
    folder, frame, _, _ = trained
    rows = frame.where("split = 'test'")
    model = ml.fit_stacked(frame.where("split = 'train'"), ["x1", "noise"], 42, ml.LearnerSize(rounds=2, trees=3, depth=2, fast=True))
    table = {r.feature: r for r in ml.permutation_importance(model, rows, repeats=2, buckets=3, bucket_rows=40).collect()}
    bucket = F.pmod(F.xxhash64("symbol", "datetime"), F.lit(4))  # 160 rows, 40 to a bucket
    keyed = rows.select("*", bucket.alias("b"), *[F.xxhash64("symbol", "datetime", F.lit(r)).alias(f"h{r}") for r in range(2)]).collect()

    def auc(values):
        changed = spark.createDataFrame([(r.symbol, r.datetime, r.future_direction, *values(r)) for r in keyed], "symbol string, datetime timestamp, future_direction int, x1 double, noise double")
        scored = [(p.prob_raw, p.future_direction) for p in model.score(changed).collect()]
        up, down = [p for p, y in scored if y], [p for p, y in scored if not y]
        return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))

    base = auc(lambda r: (r.x1, r.noise))
    for feature in ("x1", "noise"):
        drops = []
        for k in range(2):
            partner = {}
            for b in {r.b for r in keyed}:
                own = [r for r in keyed if r.b == b]
                home = sorted(own, key=lambda r: (r.symbol, r.datetime))
                partner |= {(h.symbol, h.datetime): o for h, o in zip(home, sorted(own, key=lambda r: r[f"h{k}"]))}
            swap = lambda r: partner[(r.symbol, r.datetime)][feature]
            drops.append(base - auc(lambda r: (swap(r), r.noise) if feature == "x1" else (r.x1, swap(r))))
        assert abs(table[feature].importance_mean - sum(drops) / 2) < 1e-9
    assert table["x1"].importance_mean > 0.1
