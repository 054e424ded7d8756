"""Model tables derived from the generic star-schema test tables.

``lineitem`` stands in for raw prints (one symbol per supplier), ``events`` for
a second, event-time price stream, ``orders`` for a date-only calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barweave.sources.bars import build_bars


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; naive file timestamps are read as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def line_sequence(period_start) -> Column:
    """One sortable number per line inside a period: day, order, line number, price in cents.

    A single fixed-width key keeps the bar aggregation hash-based; a struct key
    would force Spark to sort all raw rows first.  Lines equal in all four are
    copies of one print.
    """
    day_order = (
        F.datediff("l_shipdate", period_start).cast("decimal(3,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
        + F.col("l_orderkey").cast("decimal(19,0)")
    ).cast("decimal(22,0)")
    line_price = F.col("l_linenumber").cast("bigint") * 10**12 + F.round(F.col("l_extendedprice") * 100).cast("bigint")
    shifted = (day_order * F.lit(str(10**15)).cast("decimal(16,0)")).cast("decimal(38,0)")
    return (shifted + line_price.cast("decimal(16,0)")).cast("decimal(38,0)")


def weekly_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier-week bars; price is the unit price of a line."""
    li = table(spark, folder, "lineitem")
    week = F.date_trunc("week", "l_shipdate")
    return build_bars(
        li,
        symbol=F.col("l_suppkey"),
        period=week,
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        order=[line_sequence(week)],
        volume=F.col("l_quantity"),
    )


def event_day_bars(spark: SparkSession, folder: str) -> DataFrame:
    """User-day bars from event values; volume counts events."""
    ev = table(spark, folder, "events")
    micros = F.unix_micros("ts").cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
    return build_bars(
        ev,
        symbol=F.col("user_id"),
        period=F.date_trunc("day", "ts"),
        price=F.col("value"),
        order=[(micros.cast("decimal(38,0)") + F.col("event_id").cast("decimal(19,0)")).cast("decimal(38,0)")],
    )


def disclosed_trades(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    side = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("other")
    chamber = F.when(F.col("l_linestatus") == "O", "senate").otherwise("house")
    return li.select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("trade_date"),
        F.col("l_extendedprice").alias("amount_usd"),
        side.alias("side"),
        F.col("l_partkey").alias("politician"),
        chamber.alias("chamber"),
        (F.col("l_discount") * 100).alias("disclosure_lag_days"),
    )


def quarterly_fundamentals(spark: SparkSession, folder: str) -> DataFrame:
    """Point-in-time side table: one row per supplier and quarter, known at the quarter's last day.

    Every fourth supplier-quarter (by key and quarter number) has no discount
    figure, so the table is sparse like a landed one.
    """
    li = table(spark, folder, "lineitem")
    quarter = F.date_trunc("quarter", "l_shipdate")
    q = (
        li.groupBy(F.col("l_suppkey").alias("symbol"), quarter.alias("quarter_start"))
        .agg(
            F.sum("l_extendedprice").alias("revenue"),
            F.avg("l_discount").alias("mean_discount"),
            F.count(F.lit(1)).alias("line_count"),
        )
        .withColumn(
            "asof_datetime",
            F.date_trunc("day", F.last_day(F.add_months("quarter_start", 2))),
        )
    )
    sparse = (F.col("symbol") + F.quarter("quarter_start")) % 4 == 0
    return q.select(
        "symbol",
        "asof_datetime",
        "revenue",
        F.when(~sparse, F.col("mean_discount")).alias("mean_discount"),
        F.col("line_count").cast("double").alias("line_count"),
    )


# Stand-in names for date-keyed series, assigned by customer number and by order priority.
SERIES_BY_CUSTOMER = (
    "macro_proxy_spy",
    "macro_proxy_tlt",
    "macro_proxy_iwm",
    "macro_proxy_qqq",
    "macro_proxy_hyg",
    "macro_proxy_lqd",
    "macro_fmp_market_risk_premium",
    "macro_fmp_risk_free_rate",
    "macro_sector_perf_a",
    "macro_sector_perf_b",
    "macro_sector_pe_a",
    "macro_sector_pe_b",
)
SERIES_BY_PRIORITY = {
    "1-URGENT": "macro_fred_dgs10",
    "2-HIGH": "macro_fred_dgs2",
    "3-MEDIUM": "macro_fred_dgs3m",
    "4-NOT SPECIFIED": "macro_fred_cpi",
    "5-LOW": "macro_fred_vix",
}
SERIES_BY_STATUS = {"P": "macro_tsy_5y"}
MACRO_SERIES = (*SERIES_BY_CUSTOMER, *SERIES_BY_PRIORITY.values(), *SERIES_BY_STATUS.values())


def macro_long(spark: SparkSession, folder: str) -> DataFrame:
    """Long (datetime, series, value) table: one value per day and series, days may miss."""
    orders = table(spark, folder, "orders")
    by_customer = F.element_at(F.array(*map(F.lit, SERIES_BY_CUSTOMER)), (F.col("o_custkey") % 12 + 1).cast("int"))

    def mapped(column, names):
        pairs = [F.lit(x) for kv in names.items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), F.col(column))

    long = orders.select(
        F.col("o_orderdate").alias("datetime"),
        (F.col("o_totalprice") / 100000.0).alias("value"),
        F.explode(
            F.array_compact(
                F.array(by_customer, mapped("o_orderpriority", SERIES_BY_PRIORITY), mapped("o_orderstatus", SERIES_BY_STATUS))
            )
        ).alias("series"),
    )
    return long.groupBy("datetime", "series").agg(F.avg("value").alias("value"))


def statements(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Income, cash-flow and balance analogues per supplier and quarter / year."""
    li = table(spark, folder, "lineitem")
    price, disc, tax, qty = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))

    def by(unit: str, columns: dict[str, Column]) -> DataFrame:
        period = F.date_trunc(unit, "l_shipdate").alias("date")
        return li.groupBy(F.col("l_suppkey").alias("symbol"), period).agg(*[F.sum(x).alias(n) for n, x in columns.items()])

    income = {
        "revenue": price,
        "gross_profit": price * (1 - disc) * 0.6,
        "operating_expenses": price * tax,
        "depreciation": qty,
        "net_income": price * (0.3 - disc),
        "interest_expense": qty * 5,
        "ebitda": price * 0.4,
        "income_tax": price * tax * 0.5,
        "pretax_income": price * 0.35,
    }
    cash = {"operating_cashflow": price * (0.25 - disc)}
    balance = {
        "total_equity": price * 2,
        "total_liabilities": price * 1.5,
        "total_debt": price * 0.8,
        "cash": qty * 100,
        "preferred": qty,
    }
    return {
        "income": by("quarter", income),
        "cash": by("quarter", cash),
        "annual_income": by("year", {"revenue": price}),
        "annual_cash": by("year", cash),
        "balance": by("quarter", balance),
    }


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Latest price, range and two averages per supplier."""
    bars = weekly_bars(spark, folder)
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("datetime")))
    close = F.col("close")
    prices = (
        bars.withColumn("_age", age)
        .groupBy("symbol")
        .agg(
            F.max_by("close", "datetime").alias("price"),
            F.max("high").alias("year_high"),
            F.min("low").alias("year_low"),
            F.avg(F.when(F.col("_age") <= 50, close)).alias("avg_50"),
            F.avg(F.when(F.col("_age") <= 200, close)).alias("avg_200"),
        )
    )
    firms = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("symbol"),
        (F.col("s_acctbal") * 10000).alias("market_cap"),
        ((F.col("s_suppkey") % 50 + 1) * 10000).cast("double").alias("shares"),
    )
    return firms.join(prices, "symbol")


def benchmark_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Equal-weight mean close per week as one benchmark symbol."""
    mean = weekly_bars(spark, folder).groupBy("datetime").agg(F.avg("close").alias("close"))
    return mean.select(F.lit("BENCH").alias("symbol"), "datetime", "close")
