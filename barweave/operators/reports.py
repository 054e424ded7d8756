"""Latest-bar signals, regime snapshots, importance tables, interval comparison, monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barweave.functions.missing import ratio
from barweave.functions.windows import by_symbol, pct_change
from barweave.operators import patterns as pt, signals as sg
from barweave.sources.bars import resample


def latest_rows(frame: DataFrame) -> DataFrame:
    """Newest row per symbol; combined map-side, so no symbol travels whole."""
    packed = F.struct(*frame.columns)
    return frame.groupBy("symbol").agg(F.max_by(packed, "datetime").alias("_r")).select("_r.*")


def scan_signals(scored: DataFrame, min_confidence: float = 0.0, top_n: int = 50) -> DataFrame:
    """Ranked signal list from latest rows scored by one or more models.

    Needs symbol, datetime, pattern, model_file, prob_up, model_roc_auc,
    long_threshold, short_threshold; the best row of each symbol is kept.  A
    ``position`` (1, -1, 0), where a meta filter has set one, goes before the thresholds.
    """
    p, lt, st = F.col("prob_up"), F.col("long_threshold"), F.col("short_threshold")
    if "position" in scored.columns:
        signal = F.when(F.col("position") < 0, "down").when(F.col("position") > 0, "up")
    else:
        signal = F.when(p <= st, "down").when(p >= lt, "up")
    active = scored.withColumn("signal", signal).where(F.col("signal").isNotNull())
    up = F.col("signal") == "up"
    active = active.withColumns(
        {
            "prob_down": 1.0 - p,
            "confidence": F.when(up, p).otherwise(1.0 - p),
            "edge": F.when(up, p - lt).otherwise(st - p),
        }
    ).where(F.col("confidence") >= min_confidence)
    order = F.struct("confidence", "model_roc_auc", "edge", "pattern", "model_file")
    best = active.groupBy("symbol").agg(F.max_by(F.struct(*active.columns), order).alias("_r")).select("_r.*")
    return best.orderBy(F.desc("confidence"), F.desc("model_roc_auc"), F.desc("edge"), "symbol").limit(top_n)


# Regime flags of the snapshot.
REGIME_FLAGS = (
    "macro_regime_high_stress",
    "macro_regime_risk_off",
    "regime_high_vol_downtrend",
    "regime_low_vol_uptrend",
)


def regime_snapshot(dataset: DataFrame) -> DataFrame:
    """Rows, share and mean future return while each regime flag is on."""
    names = [c for c in REGIME_FLAGS if c in dataset.columns]
    on = {c: F.coalesce(F.col(c), F.lit(0.0)) > 0 for c in names}
    one = dataset.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.sum(on[c].cast("bigint")).alias(f"{c}__rows") for c in names],
        *[F.avg(F.when(on[c], F.col("future_return"))).alias(f"{c}__ret") for c in names],
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("regime"), F.col(f"{c}__rows").alias("rows"), F.col(f"{c}__ret").alias("avg_future_return")) for c in names]
    )
    long = one.select("_all", F.explode(entries).alias("_e")).select("_all", "_e.*")
    return long.where(F.col("rows") > 0).select("regime", "rows", ratio(F.col("rows"), F.col("_all")).alias("share"), "avg_future_return")


def top_importance(table: DataFrame, n: int = 20) -> DataFrame:
    """Best ``n`` features per (pattern, interval, horizon, model); ranks are made when absent."""
    if "rank" not in table.columns:
        keys = ["pattern", "interval", "horizon_bars", "model_name"]
        w = Window.partitionBy(*keys).orderBy(F.desc("importance_abs"), "feature")
        table = table.withColumn("rank", F.row_number().over(w))
    return table.where(F.col("rank") <= n)


def sweep_intervals(bars: DataFrame, units: tuple[str, ...] = ("week", "month", "quarter")) -> DataFrame:
    """Compare blind pattern trading over several bar lengths in one job."""
    parts = [resample(bars, u).withColumn("symbol", F.concat_ws("|", F.lit(u), F.col("symbol"))) for u in units]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    frame = sg.add_realized_return(pt.add_patterns(every))
    hits = pt.fan_out(frame).withColumn("interval", F.substring_index("symbol", "|", 1))
    table = sg.summary(sg.blind_trades(hits, sg.Costs()), ["interval", "member"])
    rows = frame.groupBy(F.substring_index("symbol", "|", 1).alias("interval")).agg(F.count(F.lit(1)).alias("dataset_rows"))
    best = table.groupBy("interval").agg(
        F.max("cumulative_return").alias("best_pattern_return"),
        F.avg("cumulative_return").alias("mean_pattern_return"),
        F.max("sharpe").alias("best_pattern_sharpe"),
    )
    return rows.join(best, "interval")


def month_end(bars: DataFrame) -> DataFrame:
    """Last close per symbol and month, with its change from the previous month present."""
    monthly = bars.groupBy("symbol", F.last_day("datetime").cast("timestamp").alias("datetime")).agg(
        F.max_by("close", "datetime").alias("close")
    )
    return monthly.withColumn("ret", pct_change(F.col("close"), by_symbol()))
