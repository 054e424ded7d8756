"""Candlestick patterns as flags over the current and the two previous bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barweave.functions.missing import flag, ratio
from barweave.functions.windows import by_symbol, roll_median

# Pattern names in label priority order.
PATTERNS = (
    "bullish_engulfing",
    "bearish_engulfing",
    "hammer",
    "shooting_star",
    "doji",
    "morning_star",
    "evening_star",
    "bullish_harami",
    "bearish_harami",
    "piercing_line",
    "dark_cloud_cover",
)
NO_PATTERN = "none"

# Name parts that mark a pattern as bearish.
BEARISH_WORDS = ("bearish", "shooting_star", "evening_star", "dark_cloud_cover")

# Shape limits of the patterns.
LONG_SHADOW, SHORT_SHADOW, SHADOW_SLACK = 2.2, 0.6, 1e-9
SMALL_BODY, DOJI_BODY, STAR_BODY, STAR_LOOKBACK = 0.45, 0.1, 0.6, 20


def pattern_column(name: str) -> str:
    return f"pattern_{name}"


def add_patterns(bars: DataFrame) -> DataFrame:
    """Add one 0/1 column per pattern and the primary label ``pattern`` (NULL when none)."""
    w = by_symbol()
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    step1 = bars.withColumns(
        {
            "_body": F.abs(c - o),
            "_po": F.lag(o).over(w),
            "_ph": F.lag(h).over(w),
            "_pl": F.lag(l).over(w),
            "_pc": F.lag(c).over(w),
            "_p2o": F.lag(o, 2).over(w),
            "_p2c": F.lag(c, 2).over(w),
        }
    )
    body, po, ph, pl, pc, p2o, p2c = (F.col(x) for x in ("_body", "_po", "_ph", "_pl", "_pc", "_p2o", "_p2c"))
    step2 = step1.withColumns({"_pbody": F.abs(pc - po), "_p2body": F.abs(p2c - p2o)})
    pbody, p2body = F.col("_pbody"), F.col("_p2body")
    step3 = step2.withColumn("_p2median", roll_median(p2body, w, STAR_LOOKBACK, 1))

    up, down, was_up, was_down = c > o, c < o, pc > po, pc < po
    upper = h - F.greatest(o, c)
    lower = F.least(o, c) - l
    share = ratio(body, h - l)
    mid1, mid2 = (po + pc) / 2, (p2o + p2c) / 2
    long_ago = p2body > F.col("_p2median")
    pause = pbody < p2body * STAR_BODY

    rules: dict[str, Column] = {
        "bullish_engulfing": up & was_down & (o <= pc) & (c >= po) & (body > pbody),
        "bearish_engulfing": down & was_up & (o >= pc) & (c <= po) & (body > pbody),
        "hammer": (lower > LONG_SHADOW * body)
        & (upper < SHORT_SHADOW * body + SHADOW_SLACK)
        & (share < SMALL_BODY),
        "shooting_star": (upper > LONG_SHADOW * body)
        & (lower < SHORT_SHADOW * body + SHADOW_SLACK)
        & (share < SMALL_BODY),
        "doji": share <= DOJI_BODY,
        "morning_star": (p2c < p2o) & long_ago & pause & up & (c > mid2),
        "evening_star": (p2c > p2o) & long_ago & pause & down & (c < mid2),
        "bullish_harami": was_down & up & (o > pc) & (c < po) & (body < pbody),
        "bearish_harami": was_up & down & (o < pc) & (c > po) & (body < pbody),
        "piercing_line": was_down & up & (o < pl) & (c > mid1) & (c < po),
        "dark_cloud_cover": was_up & down & (o > ph) & (c < mid1) & (c > po),
    }
    flagged = step3.select(*bars.columns, *[flag(rules[p]).alias(pattern_column(p)) for p in PATTERNS])
    return flagged.withColumn("pattern", primary_pattern())


def primary_pattern() -> Column:
    return F.coalesce(*[F.when(F.col(pattern_column(p)) == 1, F.lit(p)) for p in PATTERNS])


def pattern_hits(flagged: DataFrame, name: str) -> DataFrame:
    """Rows showing ``name``; ``none`` means rows without any label."""
    if name == NO_PATTERN:
        return flagged.where(F.col("pattern").isNull())
    if pattern_column(name) not in flagged.columns:
        raise ValueError(f"unknown pattern {name}")
    return flagged.where(F.col(pattern_column(name)) == 1)


def pattern_subset(flagged: DataFrame, name: str) -> DataFrame:
    """As :func:`pattern_hits`, but an unknown name gives an empty frame."""
    if name != NO_PATTERN and pattern_column(name) not in flagged.columns:
        return flagged.limit(0)
    return pattern_hits(flagged, name)


def fan_out(flagged: DataFrame, min_rows: int = 1, with_none: bool = True) -> DataFrame:
    """One row per (bar, pattern it shows) in column ``member``; small groups dropped."""
    members = [F.when(F.col(pattern_column(p)) == 1, F.lit(p)) for p in PATTERNS]
    if with_none:
        members.append(F.when(F.col("pattern").isNull(), F.lit(NO_PATTERN)))
    long = flagged.withColumn("member", F.explode(F.array_compact(F.array(*members))))
    if min_rows <= 1:
        return long
    # at most one row per pattern name, so the keep-list is a dozen rows
    keep = long.groupBy("member").count().where(F.col("count") >= min_rows).select("member")
    return long.join(F.broadcast(keep), "member", "left_semi").select(*long.columns)


def coverage(flagged: DataFrame) -> DataFrame:
    """Count and share of bars per pattern, ``none`` included; one aggregation pass."""
    total = flagged.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(pattern_column(p)).alias(p) for p in PATTERNS],
        F.sum(F.col("pattern").isNull().cast("int")).alias(NO_PATTERN),
    )
    long = total.unpivot(["_rows"], [*PATTERNS, NO_PATTERN], "pattern", "hits")
    return long.select("pattern", F.coalesce("hits", F.lit(0)).alias("hits"), ratio(F.col("hits"), F.col("_rows")).alias("share"))


def blind_side(name: Column) -> Column:
    """-1 for bearish pattern names, +1 otherwise."""
    return F.when(F.lower(name).rlike("|".join(BEARISH_WORDS)), F.lit(-1)).otherwise(F.lit(1))
