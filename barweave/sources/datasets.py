"""Named parquet datasets: sink, scan, profile and feature-column inference."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Columns that are never model features.
RESERVED = (
    "symbol",
    "datetime",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "adj_close",
    "future_return",
    "future_market_return",
    "future_excess_return",
    "future_rank_pct",
    "future_direction",
    "pattern",
    "split",
)


def fresh_name() -> str:
    return uuid.uuid4().hex


def save_dataset(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(f"{folder}/{name}")


def load_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, symbols, date span, column count, whether labels are present."""
    labeled = {"future_return", "future_direction"} <= set(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("symbol").alias("symbols"),
        F.min("datetime").alias("first_datetime"),
        F.max("datetime").alias("last_datetime"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(int(labeled)).alias("has_labels"),
    )


def feature_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric and boolean columns that may feed a model, by name; read from the schema alone."""
    skip = {*RESERVED, *exclude}
    kinds = (T.NumericType, T.BooleanType)
    return sorted(
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, kinds) and f.name not in skip and not f.name.startswith("pattern_")
    )
