import os

import pytest

from barweave.plans import learning, strategy

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_signals_read_bars_that_are_written_once(spark):
    assert not [f for f in strategy.scored_members(spark, FOLDER).inputFiles() if "lineitem" in f]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_dataset_builds_its_bars_once(spark, monkeypatch):
    calls = []
    bars = learning.weekly_bars
    monkeypatch.setattr(learning.lb, "chronological_split", lambda frame, *a, dates=None, **k: calls.append([f for f in [*frame.inputFiles(), *dates.inputFiles()] if "lineitem" in f]) or frame.withColumn("split", learning.F.lit("train")))
    assert bars is learning.weekly_bars and learning.dataset(spark, FOLDER).count() > 0
    assert calls == [[]]
