"""Bars from a stream of prints: the batch builder's aggregates under a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def streaming_bars(
    prints: DataFrame, time_col: str, symbol: Column, price: Column, volume: Column, order: Column, length: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """One bar per (symbol, window of ``length``); state is dropped ``late`` after a window ends."""
    rows = prints.select(
        F.col(time_col).alias("_t"), symbol.alias("symbol"), price.alias("_price"), volume.alias("_volume"), order.alias("_order")
    ).withWatermark("_t", late)
    bars = rows.groupBy("symbol", F.window("_t", length).alias("_w")).agg(
        F.min_by("_price", "_order").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", "_order").alias("close"),
        F.sum("_volume").alias("volume"),
    )
    return bars.select("symbol", F.col("_w.start").alias("datetime"), "open", "high", "low", "close", "volume")
