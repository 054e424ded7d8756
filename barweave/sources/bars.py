"""Bar tables: scan, sink, vendor mapping, cleaning and building from raw prints.

A clean bar table holds one row per (symbol, datetime).  The length of one
symbol's history is therefore bounded by the calendar, however many raw prints
a symbol has: raw prints are combined map-side before they meet.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from barweave.functions.missing import finite, ratio
from barweave.functions.tables import keep_first, settle

OHLCV = ("open", "high", "low", "close", "volume")


def scan_bars(spark: SparkSession, path: str, interval: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Read a bar store; ``interval`` and ``symbols`` prune partitions, ``symbols`` is also pushed to the files."""
    # the interval is declared as text: inference would read "1d" as the number 1.0
    found = spark.read.parquet(path).drop("interval", "symbol_bucket").schema
    keys = [T.StructField("interval", T.StringType()), T.StructField("symbol_bucket", T.IntegerType())]
    bars = spark.read.schema(T.StructType([*found.fields, *keys])).parquet(path)
    if interval is not None:
        bars = bars.where(F.col("interval") == interval)
    if symbols is not None:
        # both filters: the folders of other buckets are not listed, row groups of other symbols are skipped
        bars = bars.where(F.col("symbol_bucket").isin([symbol_bucket(F.lit(s)) for s in symbols]) & F.col("symbol").isin(symbols))
    return bars.drop("symbol_bucket")


SYMBOL_BUCKETS = 64


def symbol_bucket(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol.cast("string")), F.lit(SYMBOL_BUCKETS)).cast("int")


def save_bars(bars: DataFrame, path: str, interval: str, mode: str = "upsert") -> None:
    """Write bars under their interval and a hash bucket of the symbol, sorted inside each file so symbol filters skip row groups.

    By default the bars of a symbol take the place of all it had for the interval; only the buckets of the symbols that are
    saved are written anew, with the other symbols they hold.  ``append`` adds, ``overwrite`` clears the whole store.
    """
    spark = bars.sparkSession
    rows = bars.withColumns({"interval": F.lit(interval), "symbol_bucket": symbol_bucket(F.col("symbol"))})
    if mode == "upsert":
        rows = settle(rows)
        rows = settle(rows.unionByName(_others(spark, rows, path, interval), allowMissingColumns=True))
    dealt = rows.repartition("symbol_bucket").sortWithinPartitions("symbol_bucket", "symbol", "datetime")
    writer = dealt.write.mode("overwrite" if mode == "upsert" else mode).partitionBy("interval", "symbol_bucket")
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "upsert" else writer).parquet(path)


def _others(spark: SparkSession, rows: DataFrame, path: str, interval: str) -> DataFrame:
    """Stored bars of other symbols in the buckets that are about to be written; they have to be kept."""
    try:
        stored = scan_bars(spark, path, interval)
    except AnalysisException as error:
        if not any(word in str(error) for word in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return rows.limit(0)
    buckets = [r.symbol_bucket for r in rows.select("symbol_bucket").distinct().collect()]  # 64 at most
    stored = stored.withColumn("symbol_bucket", symbol_bucket(F.col("symbol"))).where(F.col("symbol_bucket").isin(buckets))
    return stored.join(rows.select("symbol").distinct(), "symbol", "left_anti")


# Field names of the compact vendor payload and their bar columns.
VENDOR_FIELDS = {
    "o": "open",
    "h": "high",
    "l": "low",
    "c": "close",
    "v": "volume",
    "n": "transactions",
    "vw": "vwap",
}


def from_vendor(raw: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Compact payload (epoch milliseconds in ``t``) to bar columns."""
    lead = [] if symbol is None else [symbol.alias("symbol")]
    return raw.select(
        *lead,
        F.timestamp_millis(F.col("t")).alias("datetime"),
        *[F.col(a).alias(b) for a, b in VENDOR_FIELDS.items() if a in raw.columns],
    )


def _matched_columns(raw: DataFrame) -> dict[str, str]:
    """Lower-cased, trimmed name -> actual name, first occurrence wins."""
    found: dict[str, str] = {}
    for name in raw.columns:
        found.setdefault(name.strip().lower(), name)
    if "datetime" not in found and "date" in found:
        found["datetime"] = found["date"]
    for spelled in ("adj close", "adjclose"):
        if "adj_close" not in found and spelled in found:
            found["adj_close"] = found[spelled]
    return found


def normalize_bars(raw: DataFrame, keys: tuple[str, ...] = ("symbol",), order: list[Column] | None = None) -> DataFrame:
    """Coerce, drop incomplete rows, scale to adjusted prices, keep the first row per (keys, datetime).

    ``order`` says which duplicate is first; by default the smallest row.
    """
    found = _matched_columns(raw)
    missing = [c for c in ("datetime", *OHLCV) if c not in found]
    if missing:
        raise ValueError(f"bar columns missing: {missing}")
    numeric = [c for c in (*OHLCV, "adj_close") if c in found]
    extra = [] if order is None else [o.alias(f"_o{i}") for i, o in enumerate(order)]
    bars = raw.select(
        *[F.col(f"`{found.get(k, k)}`").alias(k) for k in keys],
        F.col(f"`{found['datetime']}`").cast("string").try_cast("timestamp").alias("datetime"),
        *[finite(F.col(f"`{found[c]}`").cast("string").try_cast("double")).alias(c) for c in numeric],
        *extra,
    ).dropna(subset=["datetime", *OHLCV])
    by = [F.col(f"_o{i}") for i in range(len(extra))] or [F.col(c) for c in numeric]
    bars = keep_first(bars, [*keys, "datetime"], by).drop(*[f"_o{i}" for i in range(len(extra))])
    return adjust_prices(bars) if "adj_close" in numeric else bars


def adjust_prices(bars: DataFrame) -> DataFrame:
    """Scale open/high/low/close by adj_close/close where both are positive."""
    factor = F.when((F.col("close") > 0) & (F.col("adj_close") > 0), ratio(F.col("adj_close"), F.col("close")))
    scaled = {c: F.col(c) * F.coalesce(F.col("_factor"), F.lit(1.0)) for c in ("open", "high", "low")}
    scaled["close"] = F.when(F.col("_factor").isNotNull(), F.col("adj_close")).otherwise(F.col("close"))
    return bars.withColumn("_factor", factor).withColumns(scaled).drop("_factor")


def clip_years(bars: DataFrame, years: int, as_of: Column) -> DataFrame:
    """Keep rows of the last ``years`` years before ``as_of`` (at least one)."""
    return bars.where(F.col("datetime") >= F.add_months(as_of, -12 * max(1, years)))


def years_ago_window(bars: DataFrame, start_years_ago: int | None, end_years_ago: int | None, as_of: Column) -> DataFrame:
    """Keep dates between ``start`` and ``end`` years before ``as_of``, either order, both ends included."""
    if start_years_ago is None and end_years_ago is None:
        return bars
    ages = [max(0, a or 0) for a in (start_years_ago, end_years_ago)]
    older, newer = max(ages), min(ages)
    day = F.to_date("datetime")
    return bars.where(day.between(F.add_months(as_of, -12 * older), F.add_months(as_of, -12 * newer)))


def minimum_history(bars: DataFrame, rows: int = 120) -> DataFrame:
    """Drop symbols with fewer than ``rows`` bars."""
    long_enough = bars.groupBy("symbol").count().where(F.col("count") >= rows).select("symbol")
    return bars.join(long_enough, "symbol", "left_semi").select(*bars.columns)


def build_bars(
    prints: DataFrame,
    symbol: Column,
    period: Column,
    price: Column,
    order: list[Column],
    volume: Column | None = None,
) -> DataFrame:
    """Combine raw prints to one bar per (symbol, period); ``order`` decides open and close."""
    prints = prints.select(
        symbol.alias("symbol"),
        period.alias("datetime"),
        price.alias("_price"),
        (F.struct(*order) if len(order) > 1 else order[0]).alias("_order"),
        (F.lit(1.0) if volume is None else volume).alias("_volume"),
    )
    return prints.groupBy("symbol", "datetime").agg(
        F.min_by("_price", "_order").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", "_order").alias("close"),
        F.sum("_volume").alias("volume"),
    )


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Coarser bars from finer ones (``unit`` as in ``date_trunc``)."""
    return (
        bars.groupBy("symbol", F.date_trunc(unit, "datetime").alias("_period"))
        .agg(
            F.min_by("open", "datetime").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "datetime").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_period", "datetime")
    )


def most_recent(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest rows (top-k per partition, then merge; no full sort)."""
    return df.orderBy(F.desc("datetime"), "symbol").limit(n)
