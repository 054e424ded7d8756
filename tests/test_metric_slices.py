from pyspark.sql import functions as F

from barweave.operators import learn as ml


def scored(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 20 == 0, "rare").otherwise("often").alias("pattern"), (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 7919 % 6007) / 6007.0).alias("p")
    )
    return rows.repartition(8, "p")


def test_no_key_is_shuffled_whole(spark, capsys):
    """Scores move by key and value range; a join on the key alone would bring a whole key to one task."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ml.binary_metrics(scored(spark), ["pattern"], "y", "p").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_more_slices_change_no_figure(spark):
    few = ml.binary_metrics(scored(spark), ["pattern"], "y", "p", slices=2).orderBy("pattern").collect()
    many = ml.binary_metrics(scored(spark), ["pattern"], "y", "p", slices=2, slice_rows=50).orderBy("pattern").collect()
    assert len(few) == 2
    for a, b in zip(few, many):
        assert a.pattern == b.pattern and all(abs(x - y) < 1e-12 for x, y in zip(a[1:], b[1:]))
