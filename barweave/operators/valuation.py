"""Statement-based valuation: one row per symbol from quarterly, annual, balance and quote tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.missing import clip, ratio
from barweave.functions.tables import add_place, keep_last
from barweave.operators.reports import month_end

# Fixed values of the model.
MARKET_RETURN, DEBT_SPREAD, DEFAULT_RATE = 0.08, 0.03, 0.0425
WACC_LOW, WACC_HIGH, RATE_HIGH = 0.02, 0.35, 0.2
BETA_LOW, BETA_HIGH, BETA_MONTHS = -3.0, 5.0, 12
BETA_DAYS = 1899  # 5.2 years
YEARS_OF_DATA, DCF_YEARS, TERMINAL_GROWTH, MIN_GROWTH_YEARS = 10, 5, 0.02, 3
DCF_WEIGHT, REVENUE_WEIGHT, HAIRCUT = 0.60, 0.40, 0.90

# Ladders as (strictly above, value), last entry is the rest.
REVENUE_MULTIPLES = ((0.30, 15.0), (0.25, 12.0), (0.20, 9.0), (0.18, 5.0), (0.15, 4.0), (0.10, 2.5), (None, 1.0))
GROWTH_STEPS = ((0.50, 1.20), (0.25, 1.15), (0.10, 1.10), (0.0, 1.0))
MARGIN_STEPS = ((0.70, 1.15), (0.60, 1.10), (0.50, 1.05), (0.40, 1.0), (0.30, 0.90), (0.20, 0.80), (None, 0.70))


def ladder(x: Column, steps) -> Column:
    chain = None
    for above, value in steps:
        if above is None:
            return chain.otherwise(value)
        chain = F.when(x > above, value) if chain is None else chain.when(x > above, value)
    return chain


def _newest_first(table: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` statements per symbol, numbered from 0."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return table.withColumn("_q", F.row_number().over(w) - 1).where(F.col("_q") < n)


def trailing_sums(income: DataFrame, cash: DataFrame) -> DataFrame:
    """Sums of the four newest quarters and of the four before; only quarters both statements reach count as trailing."""
    i, c = _newest_first(income, 8), _newest_first(cash, 4)
    reach = c.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n_cash"))
    zero = lambda col: F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    joined = i.join(reach, "symbol", "left").fillna(0, ["_n_cash"])
    now, before = (F.col("_q") < 4) & (F.col("_q") < F.col("_n_cash")), F.col("_q") >= 4
    dep = zero("depreciation")
    operating = zero("gross_profit") - zero("operating_expenses") - dep
    items = {
        "revenue": zero("revenue"), "gross": zero("gross_profit"), "income": zero("net_income"), "interest": zero("interest_expense"),
        "ebit": zero("ebitda") - dep, "operating": operating, "tax": zero("income_tax"), "pretax": zero("pretax_income"),
    }
    total = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0))
    sums = joined.groupBy("symbol").agg(
        *[total(now, x).alias(f"ttm_{k}") for k, x in items.items()],
        *[total(before, items[k]).alias(f"prior_{k}") for k in ("revenue", "gross", "operating")],
        F.count(F.lit(1)).alias("_n_income"),
    )
    flow = (
        c.join(sums.select("symbol", "_n_income"), "symbol")
        .where(F.col("_q") < F.col("_n_income"))
        .groupBy("symbol")
        .agg(F.sum(zero("operating_cashflow")).alias("ttm_ocf"))
    )
    return sums.drop("_n_income").join(flow, "symbol", "left").fillna(0.0, ["ttm_ocf"])


def geometric_growth(annual: DataFrame, field: str, out: str, years: int = YEARS_OF_DATA) -> DataFrame:
    """Yearly growth over the unbroken run of positive values, newest first; and the years used."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    limit = F.when(n > years, F.lit(years)).otherwise(n - 1)
    value, older = F.col(field).cast("double"), F.lead(F.col(field).cast("double")).over(w)
    steps = annual.withColumns({"_k": F.row_number().over(w) - 1, "_limit": limit, "_older": older})
    sound = F.coalesce((F.col("_k") < F.col("_limit")) & (value > 0) & (F.col("_older") > 0), F.lit(False))
    steps = steps.withColumn("_sound", sound.cast("int"))
    unbroken = F.min("_sound").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    kept = steps.withColumn("_log", F.when(unbroken, F.ln(value / F.col("_older"))))
    total, used = F.sum("_log"), F.count("_log")
    return kept.groupBy("symbol").agg(
        F.coalesce(F.exp(F.try_divide(total, used)) - 1.0, F.lit(0.0)).alias(f"{out}_growth"), used.alias(f"{out}_years")
    )


def monthly_beta(bars: DataFrame, benchmark: DataFrame, as_of: Column | None = None, days: int | None = BETA_DAYS) -> DataFrame:
    """Beta of month-end changes to the benchmark over the ``days`` up to ``as_of`` (its newest date, if none is given).

    ``days`` None: over all bars.  1 when months are few or the benchmark is flat; the first month inside has no change.
    """
    end = benchmark.agg((F.max("datetime") if as_of is None else F.max(as_of)).alias("_end"))
    symbols = bars.select("symbol").distinct()

    def recent(frame):
        near = frame.crossJoin(F.broadcast(end))  # one row
        return near.where(F.col("datetime").between(F.timestamp_add("DAY", F.lit(-days), F.col("_end")), F.col("_end"))).drop("_end")

    if days is not None:
        bars, benchmark = recent(bars), recent(benchmark)
    stock = month_end(bars).where(F.col("ret").isNotNull()).select("symbol", "datetime", F.col("ret").alias("_s"))
    bench = month_end(benchmark).where(F.col("ret").isNotNull()).select("datetime", F.col("ret").alias("_b"))
    paired = stock.join(bench, "datetime").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.covar_pop("_s", "_b").alias("_cov"), F.var_pop("_b").alias("_var")
    )
    good = (F.col("_n") >= BETA_MONTHS) & (F.col("_var") > 1e-12)
    beta = F.when(good, clip(F.col("_cov") / F.col("_var"), BETA_LOW, BETA_HIGH)).otherwise(1.0)
    known = paired.select("symbol", beta.alias("beta"))
    return symbols.join(known, "symbol", "left").fillna(1.0, ["beta"])


def risk_free(rate: Column) -> Column:
    """Percent figures become fractions; missing takes the default; kept inside 0 .. 0.2."""
    value = F.coalesce(rate, F.lit(DEFAULT_RATE))
    return clip(F.when(value > 1.0, value / 100.0).otherwise(value), 0.0, RATE_HIGH)


def wacc(equity: Column, liabilities: Column, beta: Column, rate: Column, tax: Column) -> Column:
    own = rate + beta * (MARKET_RETURN - rate)
    capital = equity + liabilities
    mixed = equity / capital * own + liabilities / capital * (rate + DEBT_SPREAD) * (1.0 - tax)
    return clip(F.when(capital > 0, mixed).otherwise(own), WACC_LOW, WACC_HIGH)


def revenue_value(revenue: Column, growth: Column) -> Column:
    return revenue * ladder(growth, REVENUE_MULTIPLES)


def dcf_value(ocf: Column, growth: Column, growth_years: Column, discount: Column, cash: Column, debt: Column, preferred: Column) -> Column:
    """Discounted cash flow plus terminal value and net cash; 0 without a usable growth record."""
    step = (1.0 + growth) / (1.0 + discount)
    explicit = F.aggregate(
        F.sequence(F.lit(1), F.lit(DCF_YEARS)), F.lit(0.0), lambda acc, y: acc + ocf * F.pow(step, y.cast("double"))
    )
    spread = F.greatest(F.lit(1e-9), discount - TERMINAL_GROWTH)
    terminal = ocf * F.pow(step, F.lit(float(DCF_YEARS))) * (1.0 + TERMINAL_GROWTH) / spread
    return F.when((ocf > 0) & (growth_years >= MIN_GROWTH_YEARS), explicit + terminal + cash - debt - preferred).otherwise(0.0)


def target_price(ocf_value: Column, rev_value: Column, shares: Column, yoy: Column, margin: Column) -> Column:
    base = F.when(shares > 0, (ocf_value * DCF_WEIGHT + rev_value * REVENUE_WEIGHT) / shares * HAIRCUT).otherwise(0.0)
    growth = F.coalesce(ladder(yoy, GROWTH_STEPS), F.when(yoy > -0.10, 1.0 + yoy).otherwise(0.80))
    return F.greatest(F.lit(0.0), base * growth * ladder(margin, MARGIN_STEPS))


def trend_label(price: Column, avg50: Column, avg200: Column, high: Column, low: Column) -> Column:
    """``G``/``D`` for the 50 above/below the 200 average, ``v``/``^`` for price below/above the 50, and how far."""
    golden = avg50 > avg200
    way = F.when(price < avg50, "v").otherwise("^")
    far = F.when(golden, F.try_divide(avg200 - price, avg200 - high)).otherwise(-F.try_divide(avg200 - price, avg200 - low))
    name = F.concat(F.when(golden, "G").otherwise("D"), way)
    label = F.concat(name, F.coalesce(F.concat(F.lit(" "), F.format_string("%.2f", far)), F.lit("")))
    return F.when(avg50.isNotNull() & avg200.isNotNull() & price.isNotNull(), label)


def value_companies(
    quotes: DataFrame,
    income: DataFrame,
    cash: DataFrame,
    annual_income: DataFrame,
    annual_cash: DataFrame,
    balance: DataFrame,
    betas: DataFrame,
    rate: Column,
) -> DataFrame:
    """The full table; every input joins on symbol, one row each."""
    newest = balance.groupBy("symbol").agg(F.max_by(F.struct(*balance.columns), "date").alias("_b")).select("_b.*")
    newest = newest.withColumnRenamed("date", "latest_quarter_date")
    frame = (
        keep_last(quotes, ["symbol"], [F.struct(*[c for c in quotes.columns if c != "symbol"])])
        .join(trailing_sums(income, cash), "symbol", "left")
        .join(geometric_growth(annual_income, "revenue", "revenue"), "symbol", "left")
        .join(geometric_growth(annual_cash, "operating_cashflow", "ocf"), "symbol", "left")
        .join(newest, "symbol", "left")
        .join(betas, "symbol", "left")
    )
    numbers = [c for c, t in frame.dtypes if t == "double" and (c.startswith(("ttm_", "prior_")) or c.endswith("_growth"))]
    frame = frame.fillna(0.0, [*numbers, "total_equity", "total_liabilities", "total_debt", "cash", "preferred"])
    frame = frame.fillna(1.0, ["beta"]).fillna(0, ["ocf_years", "revenue_years"])
    c = F.col
    rev, prior, gross, prior_gross = c("ttm_revenue"), c("prior_revenue"), c("ttm_gross"), c("prior_gross")
    tax = F.greatest(F.lit(0.0), F.coalesce(ratio(c("ttm_tax"), c("ttm_pretax")), F.lit(0.0)))
    step1 = frame.withColumns(
        {
            "gross_margin_ttm": F.when(rev > 0, gross / rev).otherwise(0.0),
            "operating_profit_margin_ttm": F.when(rev > 0, c("ttm_operating") / rev).otherwise(0.0),
            "yoy_revenue_growth": F.when(prior > 0, rev / prior - 1.0).otherwise(0.0),
            "yoy_gross_margin_change": F.when(
                (prior_gross > 0) & (prior > 0) & (gross > 0) & (rev > 0), (gross / rev) / (prior_gross / prior) - 1.0
            ).otherwise(0.0),
            "interest_coverage": ratio(c("ttm_ebit"), c("ttm_interest")),
            "pe_ttm": F.when(c("ttm_income") > 0, c("market_cap") / c("ttm_income")),
            "risk_free_rate": risk_free(rate),
            "_tax": tax,
        }
    )
    step2 = step1.withColumn("wacc", wacc(c("total_equity"), c("total_liabilities"), c("beta"), c("risk_free_rate"), c("_tax")))
    step3 = step2.withColumns(
        {
            "revenue_value": revenue_value(rev, c("revenue_growth")),
            "ocf_value": dcf_value(c("ttm_ocf"), c("ocf_growth"), c("ocf_years"), c("wacc"), c("cash"), c("total_debt"), c("preferred")),
        }
    )
    price = target_price(c("ocf_value"), c("revenue_value"), c("shares"), c("yoy_revenue_growth"), c("gross_margin_ttm"))
    step4 = step3.withColumn("target_price", price)
    upside = F.when(c("price") > 0, c("target_price") / c("price") - 1.0)
    return (
        step4.withColumn("upside_pct", upside)
        .withColumns(
            {
                "signal": F.when(c("upside_pct") > 0, "Buy").otherwise("Sell/Neutral"),
                "signal_strength": clip(F.abs(F.coalesce(c("upside_pct"), F.lit(0.0))), 0.0, 1.0),
                "gdx_ratio": trend_label(c("price"), c("avg_50"), c("avg_200"), c("year_high"), c("year_low")),
            }
        )
        .drop("_tax")
    )


def ranked_table(values: DataFrame) -> DataFrame:
    """Companies with their ``place``: best upside first, then strength; rows without an upside last."""
    return add_place(values, [F.desc_nulls_last("upside_pct"), F.desc_nulls_last("signal_strength"), F.col("symbol")])
