import os

import pytest

from barweave.plans.registry import REGISTRY
import barweave.plans.catalog  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_windows_are_merged_from_rows_scored_once(spark):
    """The branches read what was written once; none of them builds bars and sorts windows in the task that merges."""
    merged = REGISTRY["r17_dedupe_windows"].run(spark, FOLDER)
    assert not [f for f in merged.inputFiles() if "lineitem" in f] and merged.count() > 0
