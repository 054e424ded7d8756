"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that mean "no symbol".
NULL_SYMBOLS = ("NAN", "NONE", "NULL")

# Multiplier suffixes of abbreviated numbers.
SUFFIX_SCALE = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}


def plain_symbol(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(x)), r"\.", "-")


def is_equity_symbol(x: Column) -> Column:
    return F.coalesce(plain_symbol(x).rlike("^[A-Z]"), F.lit(False))


def strict_symbol(x: Column) -> Column:
    s = plain_symbol(x)
    return F.when(s.rlike(r"^[A-Z0-9\-]{1,10}$") & ~s.isin(*NULL_SYMBOLS), s)


def valuation_symbol(x: Column) -> Column:
    """Upper case, every character outside letters, digits, dot and dash removed."""
    return F.regexp_replace(F.upper(F.trim(x)), r"[^A-Z0-9.\-]", "")


def parse_number(x: Column) -> Column:
    """``1,234.5``, ``3.2B``, ``12%`` -> double; anything else NULL."""
    text = F.regexp_replace(F.trim(x), ",", "")
    digits = F.regexp_extract(text, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*[KMBTkmbt]?%?$", 1)
    letter = F.upper(F.regexp_extract(text, "([KMBTkmbt])%?$", 1))
    scale = F.lit(1.0)
    for suffix, factor in SUFFIX_SCALE.items():
        scale = F.when(letter == suffix, F.lit(factor)).otherwise(scale)
    return digits.try_cast("double") * scale / F.when(text.endswith("%"), 100.0).otherwise(1.0)


def parse_amount_range(x: Column) -> Column:
    """``$1,001 - $15,000`` -> struct(low, high, mid); a single number fills all three."""
    found = F.regexp_extract_all(F.regexp_replace(x, "[,$]", ""), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    numbers = F.slice(F.transform(found, lambda d: d.try_cast("double")), 1, 2)
    low, high = F.array_min(numbers), F.array_max(numbers)
    return F.when(
        F.size(numbers) > 0,
        F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2.0).alias("mid")),
    )


# Words that decide the side of a disclosed trade.
BUY_WORDS = ("purchase", "buy", "acquire", "acquisition", "received")
SELL_WORDS = ("sale", "sell", "sold", "dispose", "disposition")


def trade_side(x: Column) -> Column:
    s = F.lower(F.coalesce(x, F.lit("")))
    return (
        F.when(s.rlike("|".join(BUY_WORDS)), "buy")
        .when(s.rlike("|".join(SELL_WORDS)), "sell")
        .otherwise("other")
    )


# Grade wording and its score, first match wins.
GRADE_SCORES = (
    ("strong buy", 2.0),
    ("strong sell", -2.0),
    ("outperform|overweight", 2.0),
    ("buy|positive|accumulate", 1.0),
    ("underperform|underweight|negative|reduce", -1.0),
    ("sell", -1.0),
)


def grade_score(x: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    chain = None
    for words, score in GRADE_SCORES:
        chain = F.when(s.rlike(words), score) if chain is None else chain.when(s.rlike(words), score)
    return chain.otherwise(0.0)


def slug(x: Column, default: str = "unknown") -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def model_name(x: Column) -> Column:
    """File-safe model name; NULL when nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(x)), r"\s+", "_")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9_-]+", ""), "_+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s != "", s)
