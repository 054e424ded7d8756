import os
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 140


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_alone(tmp_path, pipeline):
    """Without the training-data operators, with or without their pipeline, the contract still imports."""
    root = pathlib.Path(contract.__file__).resolve().parent
    gone = shutil.ignore_patterns("llm", "__pycache__", ".*", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(root, tmp_path / "copy", ignore=gone)
    code = "import __spark_entry__ as c; q = c.queries(); assert len(q) > 140 and set(c.oracle_sql()) <= set(q); assert not any(n == 'pipeline' or n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_entry_runs(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["datetime", "period_return"] and rows.count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
@pytest.mark.parametrize("name", ["k12_primary_pattern", "j1_asof_raw_prints", "r6_r15_blind_period_returns", "u1_merge_intervals", "dataset_build"])
def test_query_matches_sql(spark, name):
    import duckdb

    from tools.check_queries import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert compare(contract.queries()[name](spark, FOLDER).toPandas(), con.sql(contract.oracle_sql()[name]).df()) == ""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    from pyspark.sql import functions as F

    from barweave.sources.demo import event_day_bars, table
    from barweave.streaming.bars import streaming_bars

    src = str(tmp_path / "prints")
    table(spark, FOLDER, "events").repartition(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    bars = streaming_bars(stream, "ts", F.col("user_id"), F.col("value"), F.lit(1.0), F.struct("ts", "event_id"))
    run = bars.writeStream.format("memory").queryName("live_bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    live = {(r.symbol, r.datetime): (r.open, r.close, r.volume) for r in spark.table("live_bars").collect()}
    batch = {(r.symbol, r.datetime): (r.open, r.close, r.volume) for r in event_day_bars(spark, FOLDER).collect()}
    assert live == batch
