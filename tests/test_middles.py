import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barweave.operators import learn as ml


def test_middles_are_exact(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), None if i % 3 else rng.random(), rng.randrange(4), math.nan if i % 2 else 1.0 * i) for i in range(30_001)]
    frame = spark.createDataFrame(rows, "wide double, few double, sparse double, whole int, holes double").withColumn("never", F.lit(None).cast("double")).repartition(7)
    found = ml.middles(frame, frame.columns)
    assert "never" not in found
    for i, c in enumerate(("wide", "few", "sparse", "whole", "holes")):
        known = [r[i] for r in rows if r[i] is not None and not math.isnan(r[i])]
        assert found[c] == (statistics.median_low(known), statistics.median_high(known))
    # a bracket that is too narrow at first is widened
    assert ml.middles(frame, ["wide", "few"], 1e-9) == {c: found[c] for c in ("wide", "few")}


def test_impute_equals_the_library(spark):
    from pyspark.ml.feature import Imputer

    rows = [(i, None if i % 7 == 0 else float((i * 37) % 101), None if i % 5 else i % 9) for i in range(500)]
    frame = spark.createDataFrame(rows, "i int, a double, b int")
    whole = Imputer(strategy="median", inputCols=["a", "b"], outputCols=["a", "b"], relativeError=0.0).fit(frame).transform(frame)
    assert ml.impute(frame, ["a", "b"]).orderBy("i").collect() == whole.orderBy("i").collect()


def test_no_pass_holds_a_whole_column(spark, monkeypatch):
    """The library's own medians keep every value of a column in one object; only one row may reach them."""
    from pyspark.ml.feature import Imputer

    seen, fit = [], Imputer.fit
    monkeypatch.setattr(Imputer, "fit", lambda self, frame, *a: (seen.append(frame.count()), fit(self, frame, *a))[1])
    frame = spark.range(2000).select(F.col("id").cast("string").alias("symbol"), F.col("id").cast("double").alias("x"))
    ml.impute(frame, ["x"]).count()
    assert seen == [1]
