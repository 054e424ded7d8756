"""The upserting bar store and global places."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from barweave.functions.tables import add_place
from barweave.sources import bars as sb


def bars_of(spark, symbols, close, days=3):
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, 0.5, close, 10.0) for s in symbols for i in range(days)]
    return spark.createDataFrame(rows, "symbol string, datetime timestamp, open double, high double, low double, close double, volume double")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_saving_a_symbol_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "store")
    names = [f"S{i}" for i in range(40)]
    sb.save_bars(bars_of(spark, names, 1.0), path, "1d")
    sb.save_bars(bars_of(spark, names, 9.0), path, "1h")
    before = files(path)
    sb.save_bars(bars_of(spark, ["S3", "new"], 5.0, days=2), path, "1d")
    got = {(r.symbol, r.close): r.n for r in sb.scan_bars(spark, path, "1d").groupBy("symbol", "close").agg(F.count("*").alias("n")).collect()}
    assert got == {(s, 1.0): 3 for s in names if s != "S3"} | {("S3", 5.0): 2, ("new", 5.0): 2}
    assert sb.scan_bars(spark, path, "1h").count() == 120
    same = {f for f, t in files(path).items() if before.get(f) == t}
    touched = spark.range(1).select(*[sb.symbol_bucket(F.lit(s)).alias(s) for s in ("S3", "new")]).first()
    lost = {f for f in before if f not in same}
    assert lost and all("interval=1d" in f and any(f"symbol_bucket={b}/" in f for b in touched) for f in lost)
    scan = sb.scan_bars(spark, path, "1d", ["S3"])
    assert scan.count() == 2 and "symbol_bucket" not in scan.columns
    sb.save_bars(bars_of(spark, ["S3"], 6.0, days=1), path, "1d", mode="append")
    assert sb.scan_bars(spark, path, "1d", ["S3"]).count() == 3


def test_places_follow_the_global_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.1, 0.2, 0.3, 0.5]), rng.choice(["a", "b"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, up double, name string").repartition(7)
    got = [r.id for r in add_place(df, [F.desc_nulls_last("up"), F.col("name"), F.col("id")]).orderBy("place").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))]
    places = add_place(df, [F.col("up")])
    assert sorted(r.place for r in places.collect()) == list(range(1, 501))
    assert add_place(df.limit(0), [F.col("up")]).count() == 0
