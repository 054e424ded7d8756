"""Query registry and the result form shared by Spark and SQL.

A query is a callable ``(spark, folder) -> DataFrame`` plus an output spec such
as ``"symbol:i datetime:t ret_1:d pattern:s"``.  The spec fixes names, types and
rounding on both sides: ``i`` bigint, ``s`` string, ``t`` timestamp as text,
``x`` exact double, ``d``/``dN`` double rounded to 6 / N digits.  Rounding is
floor-based with an off-centre half, so the two engines agree on decimal ties.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

HALF = 0.5000123


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def shape_frame(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in fields(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "t":
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        elif kind == "x":
            c = c.cast("double")
        else:
            scale = 10.0 ** int(kind[1:] or 6)
            moved = c.cast("double") * scale + HALF
            # floor gives a bigint; beyond 2^53 a double has no fraction left and stays as it is
            c = F.when(F.abs(moved) < 2.0**53, F.floor(moved).cast("double")).otherwise(moved) / F.lit(scale)
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(body: str, spec: str) -> str:
    """Wrap ``body`` (a full SELECT, WITH allowed) so it returns the columns of ``spec``."""
    out = []
    for name, kind in fields(spec):
        if kind == "i":
            e = f"CAST({name} AS BIGINT)"
        elif kind == "s":
            e = f"CAST({name} AS VARCHAR)"
        elif kind == "t":
            e = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
        elif kind == "x":
            e = f"CAST({name} AS DOUBLE)"
        else:
            scale = 10.0 ** int(kind[1:] or 6)
            e = f"floor(CAST({name} AS DOUBLE) * {scale} + {HALF}) / {scale}"
        out.append(f"{e} AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{body.strip()}\n) AS result"


def query(name: str, spec: str, sql: str | None = None):
    """Register a plan under ``name``; ``sql`` is its twin over the same tables."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(
            name,
            lambda spark, folder: shape_frame(fn(spark, folder), spec),
            None if sql is None else shape_sql(sql, spec),
        )
        return fn

    return add


def rounded(columns: str, kind: str = "d") -> str:
    """Spec text giving every listed column the same kind."""
    return " ".join(f"{c}:{kind}" for c in columns.split())
