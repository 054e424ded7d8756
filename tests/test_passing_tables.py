"""Tables and shuffle files that only one step needs go when it ends."""

import os

import pytest
from pyspark.sql import functions as F

from barweave.functions import tables
from barweave.llm import copies, graphs, substrings
from barweave.operators import dataset as ds


def folders(spark):
    at = f"{tables.shared_folder(spark)}"
    return {f"{kind}/{name}" for kind in ("side", "llm") if os.path.isdir(f"{at}/{kind}") for name in os.listdir(f"{at}/{kind}")}


def names(spark, before):
    return sorted(x.split("/")[1].split("-")[0] for x in folders(spark) - before)


def test_passing_keeps_only_what_lasts(spark):
    before, setting = folders(spark), spark.conf.get(tables.CLEANUP)
    with tables.passing(spark):
        inner = tables.settle(spark.range(5))
        with tables.passing(spark):
            tables.settle(spark.range(6))
            middle = tables.settle(inner.withColumn("x", F.lit(1)), lasting=True)
        assert len(folders(spark) - before) == 2 and middle.count() == 5
        out = tables.settle(middle.where("id > 1"), lasting=True)
    assert len(folders(spark) - before) == 1 and out.count() == 3
    with pytest.raises(RuntimeError), tables.passing(spark):
        tables.settle(spark.range(5))
        raise RuntimeError
    assert len(folders(spark) - before) == 1 and spark.conf.get(tables.CLEANUP) == setting


def test_settled_tables_leave_no_shuffle_files(spark):
    seen, write = [], type(spark.range(1).write).parquet
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.range(1).write), "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(tables.CLEANUP)), write(self, *a, **k))[1])
        found = tables.settle(spark.range(100).repartition(3, "id"))
    assert seen == ["true"] and found.count() == 100


def test_repeats_leave_only_their_ranges(spark):
    same = "a passage of more than fifty bytes that two documents have in common"
    rows = spark.createDataFrame([(1, f"first {same} end"), (2, f"second {same} stop"), (3, None)], "doc_id long, text string")
    before = folders(spark)
    out = substrings.remove_repeats(rows)
    assert names(spark, before) == ["ranges"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"first {same} end", 2: "secondstop", 3: ""}


def test_copies_and_components_leave_one_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, f"{text} end"), (3, "other words altogether"), (4, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("row"), "text")
    before = folders(spark)
    tops = {r.doc_id: r.top for r in copies.groups(docs).collect()}
    assert names(spark, before) == ["groups"]
    assert tops[1] == tops[2] == tops[4] != tops[3]
    before = folders(spark)
    edges = graphs.components(spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "a long, b long"))
    assert names(spark, before) == ["components"]
    assert sorted(map(tuple, edges.collect())) == [(2, 1), (3, 1), (9, 8)]


def test_ranks_of_the_dataset_are_written_and_their_counts_go(bars, spark, monkeypatch):
    made, real = [], ds.pct_ranks
    prices = [(10 + i % 7, 11 + i % 7, 9 + i % 7, 10 + (i * i) % 5) for i in range(40)]
    monkeypatch.setattr(ds, "pct_ranks", lambda *a, **k: (made.append(folders(spark)), real(*a, **k))[1])
    attached, attach = [], ds.attach
    monkeypatch.setattr(ds, "attach", lambda frame, side, own: (attached.append((folders(spark), own[0])), attach(frame, side, own))[1])
    ds.build_dataset(bars(("a", prices), ("b", prices)), indicators=False)
    (after, ranks), before = attached[0], made[0]
    assert len(after - before) == 1 and ranks.inputFiles()[0].split("/")[-2] in "".join(after - before)
