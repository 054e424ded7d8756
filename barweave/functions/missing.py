"""Missing-value rules: NULL is the only missing marker, NaN and infinity never leave an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def finite(x: Column) -> Column:
    """NaN and +-infinity become NULL."""
    # NaN sorts above infinity, so one comparison rules out both
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def finite_frame(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every floating column of a frame."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def ratio(num: Column, den: Column) -> Column:
    """NULL when either side is NULL or the denominator is zero."""
    return F.try_divide(num, den)


def flag(cond: Column) -> Column:
    """0/1 integer, NULL condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def flag_double(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def first_valid(*cols: Column) -> Column:
    """First value that is neither NULL nor an empty string."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in cols])


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x
    if low is not None:
        out = F.when(x.isNotNull(), F.greatest(out, F.lit(float(low))))
    if high is not None:
        out = F.when(x.isNotNull(), F.least(out, F.lit(float(high))))
    return out
