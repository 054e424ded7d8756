"""Landed vendor files: universe lists, disclosed-trade files, JSON payloads, rate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barweave.functions.tables import keep_last
from barweave.functions.text import is_equity_symbol, parse_number, plain_symbol

TRADE_COLUMNS = ("symbol", "trade_date", "amount_usd", "side")

# List fields of an object payload, best first.
LIST_FIELDS = ("historical", "data", "results")

# Value keys of an indicator payload, best first, and keys that are never values.
VALUE_KEYS = ("value", "close", "price", "indicator", "marketRiskPremium", "riskFreeRate", "expectedMarketReturn")
LABEL_KEYS = ("date", "symbol", "name", "country")

# Tenor columns of the rate table.
TENORS = {
    "month1": "1m",
    "month2": "2m",
    "month3": "3m",
    "month6": "6m",
    "year1": "1y",
    "year2": "2y",
    "year3": "3y",
    "year5": "5y",
    "year7": "7y",
    "year10": "10y",
    "year20": "20y",
    "year30": "30y",
}


def _require(df: DataFrame, names) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Distinct, sorted equity symbols of a CSV with a ``symbol`` column."""
    raw = spark.read.csv(path, header=True)
    _require(raw, ["symbol"])
    return universe_symbols(raw)


def universe_symbols(raw: DataFrame) -> DataFrame:
    symbol = plain_symbol(F.col("symbol"))
    return raw.where(is_equity_symbol(F.col("symbol"))).select(symbol.alias("symbol")).distinct().orderBy("symbol")


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Disclosed-trade CSV; required columns checked, values coerced, undated rows dropped."""
    raw = spark.read.csv(path, header=True)
    _require(raw, TRADE_COLUMNS)
    extra = [c for c in raw.columns if c not in TRADE_COLUMNS]
    return raw.select(
        plain_symbol(F.col("symbol")).alias("symbol"),
        F.col("trade_date").try_cast("timestamp").alias("trade_date"),
        F.coalesce(F.col("amount_usd").try_cast("double"), F.lit(0.0)).alias("amount_usd"),
        F.lower(F.trim("side")).alias("side"),
        *extra,
    ).where(F.col("trade_date").isNotNull())


def payload_items(payload: Column) -> Column:
    """A payload (JSON list, or object holding a list) as an array of JSON objects.

    Bare strings of a list become ``{"name": ...}``; of a list inside an object only the objects count.
    """
    as_list = lambda text: F.from_json(text, "array<string>")
    nested = F.coalesce(*[as_list(F.get_json_object(payload, f"$.{f}")) for f in LIST_FIELDS])
    objects = F.filter(nested, lambda x: F.ltrim(x).startswith("{"))
    items = F.when(F.ltrim(payload).startswith("["), as_list(payload)).otherwise(objects)
    return F.transform(
        items, lambda x: F.when(F.ltrim(x).startswith("{"), x).otherwise(F.to_json(F.struct(x.alias("name"))))
    )


def payload_rows(df: DataFrame, column: str = "payload", out: str = "item") -> DataFrame:
    return df.withColumn(out, F.explode(payload_items(F.col(column)))).drop(column)


def first_number(item: Column) -> Column:
    """First readable number of a JSON object: preferred keys, then any key that is not a label."""
    fields = F.from_json(item, "map<string,string>")
    preferred = [parse_number(F.try_element_at(fields, F.lit(k))) for k in VALUE_KEYS]
    others = F.filter(
        F.transform(
            F.filter(F.map_entries(fields), lambda e: ~F.lower(e["key"]).isin(*LABEL_KEYS)), lambda e: parse_number(e["value"])
        ),
        lambda v: v.isNotNull(),
    )
    return F.coalesce(*preferred, F.try_element_at(others, F.lit(1)))


def rate_table(raw: DataFrame, seq: str) -> DataFrame:
    """Tenor columns renamed and coerced, one row per date, the last landed one by ``seq``."""
    tenors = [c for c in TENORS if c in raw.columns]
    shaped = raw.select(
        F.col("date").cast("string").try_cast("timestamp").alias("datetime"),
        *[F.col(c).cast("string").try_cast("double").alias(f"macro_tsy_{TENORS[c]}") for c in tenors],
        F.col(seq).alias("_seq"),
    ).where(F.col("datetime").isNotNull())
    return keep_last(shaped, ["datetime"], [F.col("_seq")]).drop("_seq")
