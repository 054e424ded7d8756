"""Connected components by alternating stars, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tables import passing
from .common import settled


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``a, b`` for every node but the least of each component, which is ``b``.

    ``edges`` has long columns ``a > b``.  Each round hooks the neighbours of a
    node to the least of them, first those above it, then those below, which
    converges in about the square of the logarithm of a component's size.
    """
    with passing(edges.sparkSession):
        return settled(_starred(edges, max_rounds), "components", lasting=True)


def _starred(edges: DataFrame, max_rounds: int) -> DataFrame:
    edges = settled(edges.distinct(), "edges")
    before = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _mark(edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
