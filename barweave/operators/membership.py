"""Universe membership as half-open [start_date, end_date) intervals per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barweave.functions.missing import flag
from barweave.functions.text import strict_symbol

# Fixed value: start of an interval whose beginning is not recorded.
OPEN_START = "1900-01-01"


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Union of overlapping or touching intervals per symbol; empty ones dropped.

    Intervals with the same start are combined first, so a symbol carries at
    most one row per calendar date into the ordered step.
    """
    longest = (
        intervals.where(F.col("end_date") > F.col("start_date"))
        .groupBy("symbol", "start_date")
        .agg(F.max("end_date").alias("end_date"))
    )
    w = Window.partitionBy("symbol").orderBy("start_date")
    reach = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = longest.withColumn("_new", flag(reach.isNull() | (F.col("start_date") > reach)))
    numbered = opened.withColumn("_island", F.sum("_new").over(w))
    return (
        numbered.groupBy("symbol", "_island")
        .agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
        .drop("_island")
    )


def intervals_from_changes(changes: DataFrame, current: DataFrame, end: Column) -> DataFrame:
    """Rebuild intervals from a log (effective_date, added, removed) and the members at ``end``.

    Seen backwards in time the log must alternate between joining and leaving,
    starting from today's state; repeated entries of one kind are ignored.
    Joins come before leaves on one date.
    """
    sides = {"add": strict_symbol(F.col("added")), "remove": strict_symbol(F.col("removed"))}
    entries = F.array(*[F.struct(s.alias("symbol"), F.lit(k).alias("kind")) for k, s in sides.items()])
    moves = changes.select("effective_date", F.explode(entries).alias("_m")).select(
        "_m.symbol", "effective_date", "_m.kind"
    )
    moves = moves.where(F.col("symbol").isNotNull() & F.col("effective_date").isNotNull()).distinct()
    members = current.select("symbol").distinct().withColumn("_member", F.lit(True))

    back = Window.partitionBy("symbol").orderBy(F.desc("effective_date"), "kind")
    start_state = F.when(F.col("_member"), "remove").otherwise("add")
    walked = moves.join(members, "symbol", "left").withColumn(
        "_newer", F.coalesce(F.lag("kind").over(back), start_state)
    )
    kept = walked.where(F.col("kind") != F.col("_newer"))
    # An add closes the interval that ends at the next newer leave (or is still open at `end`).
    newer_leave = F.lag("effective_date").over(back)
    joined = kept.withColumn("_end", F.coalesce(newer_leave, end)).where(F.col("kind") == "add")
    bounded = joined.select("symbol", F.col("effective_date").alias("start_date"), F.col("_end").alias("end_date"))
    # The oldest event being a leave means membership began before the log.
    depth = F.struct("effective_date", (F.col("kind") == "add").cast("int").alias("later"))
    oldest = kept.groupBy("symbol").agg(F.min_by("kind", depth).alias("kind"), F.min("effective_date").alias("end_date"))
    early = oldest.where(F.col("kind") == "remove").select("symbol", _open_start().alias("start_date"), "end_date")
    untouched = members.join(kept, "symbol", "left_anti").select("symbol", _open_start().alias("start_date"), end.alias("end_date"))
    return merge_intervals(bounded.unionByName(early).unionByName(untouched))


def _open_start() -> Column:
    return F.lit(OPEN_START).cast("timestamp")


def static_intervals(symbols: DataFrame, end: Column) -> DataFrame:
    return symbols.select("symbol").distinct().select("symbol", _open_start().alias("start_date"), end.alias("end_date"))


def filter_by_membership(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """Bars inside any interval of their symbol; an empty interval table filters nothing.

    Intervals are merged first, so a symbol contributes few disjoint pieces and
    the equality on symbol keeps the semi join shuffled by key (or broadcast,
    when the planner finds it small).
    """
    if intervals.isEmpty():
        return bars
    i = merge_intervals(intervals).withColumnRenamed("symbol", "_symbol")
    inside = (
        (bars["symbol"] == i["_symbol"]) & (bars["datetime"] >= i["start_date"]) & (bars["datetime"] < i["end_date"])
    )
    return bars.join(i, inside, "left_semi")


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """CSV with symbol, start_date, end_date; coerced, empty intervals dropped, merged."""
    raw = spark.read.csv(path, header=True, schema="symbol string, start_date string, end_date string")
    clean = raw.select(
        strict_symbol(F.col("symbol")).alias("symbol"),
        F.col("start_date").try_cast("timestamp").alias("start_date"),
        F.col("end_date").try_cast("timestamp").alias("end_date"),
    ).dropna()
    return merge_intervals(clean)


def write_membership(intervals: DataFrame, path: str) -> None:
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_date", "end_date")}
    intervals.select("symbol", "start_date", "end_date").withColumns(shown).write.csv(path, header=True, mode="overwrite")
