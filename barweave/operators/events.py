"""Event tables and point-in-time side tables: parsing, daily aggregates, rolling sums, derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barweave.functions.missing import clip, first_valid, finite_frame, ratio
from barweave.functions.rowwise import row_mean
from barweave.functions.tables import keep_last
from barweave.functions.text import grade_score, parse_amount_range, strict_symbol, trade_side
from barweave.functions.windows import by_symbol, roll_z, time_frame

# Canonical side-table fields and the vendor fields that may hold them, best first.
# A field is looked up in the period tables (with and without a table suffix), then in the profile.
FIELD_SOURCES = {
    "market_cap": (("marketCapTTM", "marketCap", "mktCap"), ("marketCap", "mktCap")),
    "float_shares": (("floatShares", "freeFloat"), ("floatShares", "freeFloat")),
    "shares_outstanding": (("sharesOutstanding", "sharesOutStanding"), ("sharesOutstanding", "sharesOutStanding")),
    "trailing_pe": (("peRatioTTM", "pe"), ("pe",)),
    "forward_pe": (("forwardPE",), ("forwardPE",)),
    "peg_ratio": (("pegRatioTTM", "pegRatio"), ("pegRatio",)),
    "price_to_book": (("priceToBookRatioTTM", "priceToBook"), ("priceToBook",)),
    "price_to_sales_trailing_12m": (
        ("priceToSalesRatioTTM", "priceToSalesTrailing12Months"),
        ("priceToSalesTrailing12Months",),
    ),
    "enterprise_to_revenue": (("enterpriseValueOverRevenueTTM", "enterpriseToRevenue"), ("enterpriseToRevenue",)),
    "enterprise_to_ebitda": (("enterpriseValueOverEBITDATTM", "enterpriseToEbitda"), ("enterpriseToEbitda",)),
    "beta": (("beta",), ("beta",)),
    "debt_to_equity": (("debtEquityRatioTTM", "debtToEquityTTM", "debtToEquity"), ("debtToEquity",)),
    "current_ratio": (("currentRatioTTM", "currentRatio"), ("currentRatio",)),
    "quick_ratio": (("quickRatioTTM", "quickRatio"), ("quickRatio",)),
    "profit_margins": (("netProfitMarginTTM", "profitMargins"), ("profitMargins",)),
    "gross_margins": (("grossProfitMarginTTM", "grossMargins"), ("grossMargins",)),
    "operating_margins": (("operatingProfitMarginTTM", "operatingMargins"), ("operatingMargins",)),
    "ebitda_margins": (("ebitdaMarginTTM", "ebitdaMargins"), ("ebitdaMargins",)),
    "return_on_assets": (("returnOnAssetsTTM", "returnOnAssets"), ("returnOnAssets",)),
    "return_on_equity": (("returnOnEquityTTM", "returnOnEquity"), ("returnOnEquity",)),
    "earnings_growth": (("earningsGrowthTTM", "earningsGrowth"), ("earningsGrowth",)),
    "revenue_growth": (("revenueGrowthTTM", "revenueGrowth"), ("revenueGrowth",)),
    "free_cashflow": (("freeCashFlowTTM", "freeCashflow"), ("freeCashflow",)),
    "operating_cashflow": (("operatingCashFlowTTM", "operatingCashflow"), ("operatingCashflow",)),
}


def resolve_fields(periods: DataFrame, profile: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Canonical fields per (symbol, asof_datetime): first filled period field, then the profile."""
    have_profile = profile is not None
    if have_profile:
        renamed = profile.select("symbol", *[F.col(c).alias(f"_p_{c}") for c in profile.columns if c != "symbol"])
        periods = periods.join(renamed, "symbol", "left")
    out = []
    for name in names or FIELD_SOURCES:
        from_period, from_profile = FIELD_SOURCES[name]
        found = [
            F.col(c + suffix)
            for c in from_period
            for suffix in ("", "_ratio", "_metric")
            if c + suffix in periods.columns
        ]
        if have_profile:
            found += [F.col(f"_p_{c}") for c in from_profile if f"_p_{c}" in periods.columns]
        value = first_valid(*found).cast("double") if found else F.lit(None).cast("double")
        out.append(value.alias(name))
    return periods.select("symbol", "asof_datetime", *out)


def join_ratio_metric(ratios: DataFrame, metrics: DataFrame) -> DataFrame:
    """Full outer join of the two quarterly tables; shared fields keep both under a suffix."""
    keys = ["symbol", "asof_datetime"]
    shared = (set(ratios.columns) & set(metrics.columns)) - set(keys)
    l = ratios.select(*keys, *[F.col(c).alias(f"{c}_ratio" if c in shared else c) for c in ratios.columns if c not in keys])
    r = metrics.select(*keys, *[F.col(c).alias(f"{c}_metric" if c in shared else c) for c in metrics.columns if c not in keys])
    return l.join(r, keys, "full_outer")


def normalize_side_table(rows: DataFrame, columns: list[str], seq: str | None = None) -> DataFrame:
    """One row per (symbol, asof_datetime): per column the last non-null value by ``seq``."""
    order = F.col(seq) if seq else F.struct(*[F.col(c) for c in columns if c in rows.columns])
    keyed = rows.where(F.col("symbol").isNotNull() & F.col("asof_datetime").isNotNull())
    picks = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
        if c in rows.columns
        else F.lit(None).cast("double").alias(c)
        for c in columns
    ]
    known = [p for c, p in zip(columns, picks) if c in rows.columns]
    absent = [p for c, p in zip(columns, picks) if c not in rows.columns]
    return keyed.groupBy("symbol", "asof_datetime").agg(*known).select(
        "symbol", "asof_datetime", *[c for c in columns if c in rows.columns], *absent
    ).select("symbol", "asof_datetime", *columns)


def stale_symbols(requested: DataFrame, stored: DataFrame, signal_columns: list[str], min_rows: int = 2) -> DataFrame:
    """Requested symbols without at least ``min_rows`` stored rows that carry any signal column."""
    filled = F.coalesce(*[F.col(c).isNotNull() for c in signal_columns]) if len(signal_columns) == 1 else None
    if filled is None:
        filled = F.lit(False)
        for c in signal_columns:
            filled = filled | F.col(c).isNotNull()
    fresh = stored.where(filled).groupBy("symbol").count().where(F.col("count") >= min_rows).select("symbol")
    return requested.select("symbol").distinct().join(fresh, "symbol", "left_anti")


def refresh(stored: DataFrame, fetched: DataFrame, columns: list[str]) -> DataFrame:
    """Merge newly landed rows over stored ones, column by column."""
    both = stored.withColumn("_seq", F.lit(0)).unionByName(fetched.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return normalize_side_table(both, columns, "_seq")


def sparse_union(*tables: DataFrame) -> DataFrame:
    """Stack event tables that each fill only their own columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def analyst_ratios(rows: DataFrame) -> DataFrame:
    """Shares of buy / hold / sell opinions; needs strong_buy, buy, hold, sell, strong_sell."""
    buys, sells = zero("strong_buy") + zero("buy"), zero("sell") + zero("strong_sell")
    total = buys + zero("hold") + sells
    return rows.select(
        "symbol",
        "asof_datetime",
        total.alias("analyst_total_ratings"),
        ratio(buys, total).alias("analyst_buy_ratio"),
        ratio(zero("hold"), total).alias("analyst_hold_ratio"),
        ratio(sells, total).alias("analyst_sell_ratio"),
        ratio(buys - sells, total).alias("analyst_net_score"),
    )


def rating_scores(rows: DataFrame) -> DataFrame:
    """Numeric score, or the score of the wording when the number is missing; detail scores kept."""
    details = [c for c in rows.columns if c.startswith("rating_") and c.endswith("_score")]
    return rows.select(
        "symbol",
        "asof_datetime",
        F.coalesce(F.col("score").cast("double"), grade_score(F.col("recommendation"))).alias("rating_score"),
        *[F.col(c).cast("double").alias(c) for c in details],
    )


def earnings_surprise(rows: DataFrame) -> DataFrame:
    eps, est, rev, rev_est = (F.col(c).cast("double") for c in ("eps", "eps_estimated", "revenue", "revenue_estimated"))
    age = F.floor((F.unix_seconds("asof_datetime") - F.unix_seconds("updated_from")) / 86400.0)
    return rows.select(
        "symbol",
        "asof_datetime",
        (eps - est).alias("earnings_eps_surprise"),
        ratio(eps - est, F.abs(est)).alias("earnings_eps_surprise_pct"),
        ratio(rev - rev_est, F.abs(rev_est)).alias("earnings_revenue_surprise_pct"),
        age.cast("double").alias("earnings_estimate_age_days"),
    )


def grade_changes(rows: DataFrame, days: int = 30) -> DataFrame:
    """Net, up and down grade changes of the last ``days`` days per symbol and event date."""
    delta = grade_score(F.col("new_grade")) - grade_score(F.col("previous_grade"))
    daily = (
        rows.withColumn("_d", delta)
        .groupBy("symbol", "asof_datetime")
        .agg(
            F.sum("_d").alias("net"),
            F.sum((F.col("_d") > 0).cast("double")).alias("up"),
            F.sum((F.col("_d") < 0).cast("double")).alias("down"),
        )
    )
    w = time_frame(["symbol"], "asof_datetime", days)
    return daily.select(
        "symbol", "asof_datetime", *[F.sum(c).over(w).alias(f"analyst_grade_{c}_{days}d") for c in ("net", "up", "down")]
    )


def estimate_dispersion(rows: DataFrame, stem: str) -> DataFrame:
    """(high - low) / |avg| of analyst estimates for ``stem`` (eps or revenue)."""
    avg, high, low = (F.col(f"{stem}_{p}").cast("double") for p in ("avg", "high", "low"))
    return rows.withColumn(f"analyst_est_{stem}_dispersion", ratio(high - low, F.abs(avg)))


def price_targets(rows: DataFrame) -> DataFrame:
    mean, high, low, price = (F.col(c).cast("double") for c in ("target_mean", "target_high", "target_low", "price"))
    return rows.select(
        "symbol",
        "asof_datetime",
        mean.alias("price_target_mean"),
        high.alias("price_target_high"),
        low.alias("price_target_low"),
        ratio(mean - price, F.abs(price)).alias("price_target_upside"),
        ratio(high - low, F.abs(mean)).alias("price_target_dispersion"),
        F.col("analyst_count").cast("double").alias("price_target_analyst_count"),
    )


def consensus_grades(rows: DataFrame) -> DataFrame:
    """Buy / hold / sell totals over all wordings; missing score falls back to (buy - sell) / total."""
    buy = zero("strong_buy") + zero("buy") + zero("outperform") + zero("overweight")
    hold = zero("hold") + zero("neutral")
    sell = zero("sell") + zero("strong_sell") + zero("underperform") + zero("underweight")
    total = buy + hold + sell
    return rows.select(
        "symbol",
        "asof_datetime",
        F.coalesce(F.col("consensus_score").cast("double"), ratio(buy - sell, total)).alias("grades_consensus_score"),
        ratio(buy, total).alias("grades_consensus_buy_ratio"),
        ratio(sell, total).alias("grades_consensus_sell_ratio"),
    )


def insider_flow(rows: DataFrame, days: int = 30) -> DataFrame:
    """Signed shares and value by side, rolled over ``days`` days.

    Needs symbol, asof_datetime, side, shares, value, price; a missing value is
    shares * price.
    """
    side = trade_side(F.col("side"))
    sign = F.when(side == "buy", 1.0).when(side == "sell", -1.0).otherwise(0.0)
    value = F.coalesce(F.col("value"), F.col("shares") * F.col("price"), F.lit(0.0))
    daily = rows.groupBy("symbol", "asof_datetime").agg(
        F.sum(sign * F.coalesce(F.col("shares"), F.lit(0.0))).alias("_shares"),
        F.sum(sign * value).alias("_value"),
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.sum((side == "buy").cast("double")).alias("_buy"),
        F.sum((side == "sell").cast("double")).alias("_sell"),
    )
    w = time_frame(["symbol"], "asof_datetime", days)
    return daily.select(
        "symbol",
        "asof_datetime",
        F.sum("_shares").over(w).alias(f"insider_net_shares_{days}d"),
        F.sum("_value").over(w).alias(f"insider_net_value_{days}d"),
        F.sum("_n").over(w).alias(f"insider_trade_count_{days}d"),
        (F.sum("_buy").over(w) / (F.sum("_sell").over(w) + 1.0)).alias(f"insider_buy_sell_ratio_{days}d"),
    )


# Landed field names of disclosed trades, best first.
TRADE_FIELDS = {
    "symbol": ("symbol", "ticker", "assetTicker", "assetSymbol"),
    "trade_date": ("transactionDate", "tradeDate", "dateReceived", "date"),
    "disclosed": ("disclosureDate", "filingDate", "dateReceived", "dateRecieved"),
    "amount": ("amount", "amountRange", "transactionValue", "value"),
    "side": ("type", "transactionType", "transaction", "acquistionOrDisposition"),
    "person": ("representative", "senator", "office", "name"),
}


def parse_disclosed_trades(
    raw: DataFrame, chamber: Column, seq: Column, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Landed rows of one chamber to the trade table; copies of one trade collapse to the last by ``seq``."""

    def first_of(field, convert=lambda c: c):
        found = [convert(F.col(c)) for c in TRADE_FIELDS[field] if c in raw.columns]
        return F.coalesce(*found) if found else F.lit(None)

    as_time = lambda c: c.cast("string").try_cast("timestamp")
    filled = lambda c: F.when(F.trim(c.cast("string")) != "", c.cast("string"))
    names = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("firstName", "lastName") if c in raw.columns]
    person = F.coalesce(first_of("person", filled), F.trim(F.concat_ws(" ", *names)) if names else F.lit(""), F.lit(""))
    amount = parse_amount_range(first_of("amount", filled))
    trade_date, disclosed = first_of("trade_date", as_time), first_of("disclosed", as_time)
    parsed = raw.select(
        strict_symbol(first_of("symbol", filled)).alias("symbol"),
        trade_date.alias("trade_date"),
        F.coalesce(amount["mid"], F.lit(0.0)).alias("amount_usd"),
        trade_side(first_of("side", filled)).alias("side"),
        person.alias("politician"),
        chamber.alias("chamber"),
        F.floor((F.unix_seconds(disclosed) - F.unix_seconds(trade_date)) / 86400.0).cast("double").alias("disclosure_lag_days"),
        amount["low"].alias("amount_low_usd"),
        amount["high"].alias("amount_high_usd"),
        seq.alias("_seq"),
    ).where(F.col("symbol").isNotNull() & F.col("trade_date").isNotNull())
    if start is not None:
        parsed = parsed.where(F.col("trade_date") >= start)
    if end is not None:
        parsed = parsed.where(F.col("trade_date") <= end)
    keys = ["symbol", "trade_date", "amount_usd", "side", "politician", "chamber"]
    return keep_last(parsed, keys, [F.col("_seq")]).drop("_seq")


def daily_trades(trades: DataFrame) -> DataFrame:
    """Per symbol and date: signed / absolute flow, counts, distinct people, lag, per-chamber flow."""
    amount, side = F.col("amount_usd"), F.col("side")
    signed = F.when(side == "buy", amount).when(side == "sell", -amount).otherwise(0.0)
    chamber = F.lower(F.coalesce(F.col("chamber").cast("string"), F.lit("unknown")))
    in_chamber = {c: chamber.contains(c) for c in ("senate", "house")}
    per_chamber = []
    for c, cond in in_chamber.items():
        per_chamber.append(F.sum(F.when(cond, signed).otherwise(0.0)).alias(f"politician_{c}_signed_flow"))
        per_chamber.append(F.sum(cond.cast("double")).alias(f"politician_{c}_trade_count"))
    return (
        trades.where(F.col("symbol").isNotNull() & F.col("trade_date").isNotNull())
        .groupBy("symbol", "trade_date")
        .agg(
            F.sum(signed).alias("politician_signed_flow"),
            F.sum(amount).alias("politician_abs_flow"),
            F.count(amount).alias("politician_trade_count"),
            F.sum((side == "buy").cast("double")).alias("politician_buy_count"),
            F.sum((side == "sell").cast("double")).alias("politician_sell_count"),
            F.countDistinct("politician").alias("politician_unique_count"),
            F.avg("disclosure_lag_days").alias("politician_disclosure_lag_days"),
            *per_chamber,
        )
    )


# Rolled column -> (daily column, days).
TRADE_ROLLS = {
    "politician_flow_7d": ("politician_signed_flow", 7),
    "politician_flow_30d": ("politician_signed_flow", 30),
    "politician_flow_90d": ("politician_signed_flow", 90),
    "politician_abs_flow_30d": ("politician_abs_flow", 30),
    "politician_count_30d": ("politician_trade_count", 30),
    "politician_buy_count_30d": ("politician_buy_count", 30),
    "politician_sell_count_30d": ("politician_sell_count", 30),
    "politician_unique_count_30d": ("politician_unique_count", 30),
    "politician_senate_flow_30d": ("politician_senate_signed_flow", 30),
    "politician_house_flow_30d": ("politician_house_signed_flow", 30),
    "politician_senate_count_30d": ("politician_senate_trade_count", 30),
    "politician_house_count_30d": ("politician_house_trade_count", 30),
}


def rolling_trades(daily: DataFrame) -> DataFrame:
    """Half-open time windows over the daily table (one row per symbol and date)."""
    frames = {d: time_frame(["symbol"], "trade_date", d) for d in (7, 30, 90)}
    out = daily.withColumns({name: F.sum(c).over(frames[d]) for name, (c, d) in TRADE_ROLLS.items()})
    return out.withColumns(
        {
            "politician_disclosure_lag_30d": F.avg("politician_disclosure_lag_days").over(frames[30]),
            "politician_buy_sell_ratio_30d": F.col("politician_buy_count_30d") / (F.col("politician_sell_count_30d") + 1.0),
            "politician_flow_imbalance_30d": ratio(F.col("politician_flow_30d"), F.col("politician_abs_flow_30d")),
        }
    )


def add_value_ratios(frame: DataFrame) -> DataFrame:
    """Valuation, quality and turnover ratios; each only where its inputs exist."""
    have, c = set(frame.columns), F.col
    rules = {
        "earnings_yield": (["trailing_pe"], lambda: ratio(F.lit(1.0), c("trailing_pe"))),
        "book_to_price": (["price_to_book"], lambda: ratio(F.lit(1.0), c("price_to_book"))),
        "sales_yield": (["price_to_sales_trailing_12m"], lambda: ratio(F.lit(1.0), c("price_to_sales_trailing_12m"))),
        "free_cashflow_yield": (["free_cashflow", "market_cap"], lambda: ratio(c("free_cashflow"), c("market_cap"))),
        "operating_cashflow_yield": (
            ["operating_cashflow", "market_cap"],
            lambda: ratio(c("operating_cashflow"), c("market_cap")),
        ),
        "free_float_ratio": (["float_shares", "shares_outstanding"], lambda: ratio(c("float_shares"), c("shares_outstanding"))),
        "turnover_ratio": (["volume", "shares_outstanding"], lambda: ratio(c("volume"), c("shares_outstanding"))),
        "dollar_volume": (["close", "volume"], lambda: c("close") * c("volume")),
        "log_dollar_volume": (["close", "volume"], lambda: F.log1p(clip(c("close") * c("volume"), low=0.0))),
        "leverage_pressure": (["debt_to_equity", "current_ratio"], lambda: ratio(c("debt_to_equity"), c("current_ratio"))),
    }
    out = {name: make() for name, (needs, make) in rules.items() if set(needs) <= have}
    quality = [q for q in ("return_on_assets", "return_on_equity", "profit_margins", "operating_margins") if q in have]
    if quality:
        out["quality_composite"] = row_mean([c(q) for q in quality])
    return frame.withColumns(out)


def add_interactions(frame: DataFrame) -> DataFrame:
    """Products, blends and macro-adjusted returns; each only where its inputs exist."""
    c = F.col

    def blend(*names):
        return lambda: row_mean([c(n) for n in names])

    def product(a, b):
        return lambda: c(a) * c(b)

    rules = [
        ("analyst_rating_blend", ["analyst_net_score", "rating_score"], blend("analyst_net_score", "rating_score")),
        (
            "analyst_grade_consensus_blend",
            ["analyst_rating_blend", "grades_consensus_score"],
            blend("analyst_rating_blend", "grades_consensus_score"),
        ),
        ("analyst_quality_interaction", ["analyst_net_score", "quality_composite"], product("analyst_net_score", "quality_composite")),
        (
            "surprise_sentiment_interaction",
            ["earnings_eps_surprise_pct", "analyst_net_score"],
            product("earnings_eps_surprise_pct", "analyst_net_score"),
        ),
        (
            "price_target_sentiment_alignment",
            ["price_target_upside", "analyst_net_score"],
            product("price_target_upside", "analyst_net_score"),
        ),
        (
            "analyst_uncertainty_index",
            ["analyst_est_eps_dispersion", "price_target_dispersion"],
            blend("analyst_est_eps_dispersion", "price_target_dispersion"),
        ),
        ("insider_flow_to_mcap_30d", ["insider_net_value_30d", "market_cap"], lambda: ratio(c("insider_net_value_30d"), c("market_cap"))),
        (
            "insider_analyst_alignment",
            ["insider_buy_sell_ratio_30d", "analyst_net_score"],
            product("insider_buy_sell_ratio_30d", "analyst_net_score"),
        ),
        ("politician_flow_to_mcap_30d", ["politician_flow_30d", "market_cap"], lambda: ratio(c("politician_flow_30d"), c("market_cap"))),
        (
            "politician_insider_flow_alignment",
            ["politician_flow_30d", "insider_net_value_30d"],
            lambda: F.signum("politician_flow_30d") * F.signum("insider_net_value_30d"),
        ),
        (
            "alpha_ret_5_macro_adj",
            ["alpha_ret_5", "macro_risk_off_score"],
            lambda: c("alpha_ret_5") * (1.0 - clip(c("macro_risk_off_score"), -3.0, 3.0) / 3.0),
        ),
        (
            "ret_5_macro_shock_adj",
            ["ret_5", "macro_surprise_abs_index"],
            lambda: c("ret_5") * (1.0 - clip(F.coalesce(c("macro_surprise_abs_index"), F.lit(0.0)), 0.0, 3.0) / 3.0),
        ),
        (
            "event_risk_tension",
            ["volatility_20", "macro_days_to_next_us_major_event"],
            lambda: c("volatility_20") / (1.0 + clip(c("macro_days_to_next_us_major_event"), low=0.0)),
        ),
    ]
    for name, needs, make in rules:
        if set(needs) <= set(frame.columns):
            frame = frame.withColumn(name, make())
    return frame


def add_symbol_deltas(frame: DataFrame) -> DataFrame:
    """Per-symbol z-scores and 20-row changes of slow columns."""
    w, have, c = by_symbol(), set(frame.columns), F.col
    out = {}
    if "turnover_ratio" in have:
        out["turnover_z_20"] = roll_z(c("turnover_ratio"), w, 20, 5)
    for name in ("analyst_net_score", "rating_score", "price_target_upside"):
        if name in have:
            out[f"{name}_delta_20"] = c(name) - F.lag(name, 20).over(w)
    for name in ("insider_net_value_30d", "politician_flow_30d"):
        if name in have:
            out[f"{name}_z_63"] = roll_z(c(name), w, 63, 10)
    return frame.withColumns(out)


def add_derived(frame: DataFrame) -> DataFrame:
    return finite_frame(add_symbol_deltas(add_interactions(add_value_ratios(frame))))
