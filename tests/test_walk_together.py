"""Thresholds of all windows come from one search, and are those that each fit would find alone."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from barweave.operators import labels as lb, learn as ml, patterns as pt, signals as sg, thresholds as th, walkforward as wf

T0 = dt.datetime(2024, 1, 1)
CONFIG = ml.TrainConfig(min_rows=60, size=ml.LearnerSize(rounds=2, trees=3, depth=2, fast=True), costs=sg.Costs(), meta_filter=False)


def frame_of(spark):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        for s in range(8):
            up = rng.random() < 0.5
            gain = (0.02 if up else -0.02) + rng.gauss(0, 0.002)
            x = (1.0 if up else -1.0) * (rng.random() < 0.8)
            hammer = int(s < 4)
            rows.append((f"S{s}", T0 + dt.timedelta(days=i), 100.0 + i % 7 + s, x, None if rng.random() < 0.1 else rng.random(), int(up), gain, gain, 1, hammer, "doji"))
    names = "symbol string, datetime timestamp, close double, x double, y double, future_direction int, future_excess_return double, future_return double, pattern_doji int, pattern_hammer int, pattern string"
    frame = spark.createDataFrame(rows, names)
    return frame.withColumns({pt.pattern_column(p): F.lit(0) for p in pt.PATTERNS if p not in ("doji", "hammer")})


def test_one_search_tunes_all_windows_as_each_alone(spark, monkeypatch):
    frame = frame_of(spark)
    windows = lb.walk_forward_windows(frame, 50, 20, 20)
    searches, search = [], th.optimize_validation
    monkeypatch.setattr(th, "optimize_validation", lambda *a, **k: (searches.append(1), search(*a, **k))[1])
    fit = wf.retrain(["x", "y"], CONFIG)
    walk = lambda trainer: wf.walk_forward(frame, windows, trainer, CONFIG, ["doji", "hammer"], min_rows=60)
    key = lambda r: (r.window_no, r.pattern, r.symbol, r.datetime)
    together = walk(fit)
    rows = sorted(together.scored.collect(), key=key)
    assert len(searches) == 1 and len({(r.window_no, r.pattern) for r in rows}) >= 4
    alone = walk(lambda train, test: fit(train, test))
    assert together.scored.columns == alone.scored.columns
    assert rows == sorted(alone.scored.collect(), key=key) and {r.position for r in rows} >= {-1, 1}
    assert sorted(together.fits.collect()) == sorted(alone.fits.collect())


def test_medians_of_few_rows_take_one_pass_and_are_exact(spark):
    rng = random.Random(11)
    rows = [(rng.gauss(0, 1), None if rng.random() < 0.3 else float(rng.randrange(50)), float("nan") if i % 2 else i / 7) for i in range(19_998)]
    frame = spark.createDataFrame(rows, "a double, b double, c double").withColumn("never", F.lit(None).cast("double")).repartition(7)
    low = ml.lower_medians(frame, frame.columns, len(rows))
    whole = ml.middles(frame, frame.columns)
    assert {c: v[0] for c, v in low.items()} == {c: v[0] for c, v in whole.items()} and "never" not in low
    assert low["a"][0] == statistics.median_low([r[0] for r in rows])
