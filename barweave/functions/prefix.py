"""Rolling moments in constant work per row.

A ROWS frame is recomputed for every row, so a 200-bar statistic costs 200
updates per bar.  Here each series is accumulated once and any window is the
difference of two accumulations, whatever its length.  The accumulation starts
anew with every block of rows of a symbol, about the block's own first value: a
window, at most a block long, is the rest of one block and the start of the
next.  Work and precision therefore do not depend on the length of the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barweave.functions.missing import ratio
from barweave.functions.windows import running

#: Rows of a block, unless a window is longer.
BLOCK = 256


@dataclass(frozen=True)
class Series:
    """One accumulated series: with ``squares`` for deviations, with ``ramp`` for linearly weighted means."""

    value: Column
    squares: bool = True
    ramp: bool = False


class Rolling:
    """Rolling count, sum, mean and deviation of named series over any number of lengths."""

    def __init__(
        self, frame: DataFrame, w: WindowSpec, series: dict[str, Series], lengths: tuple[int, ...], keys: tuple[str, ...] = ("symbol",), order: str = "datetime"
    ):
        self.series = series
        self._own = list(frame.columns)
        self.block = max(BLOCK, 1 << (max(lengths) - 1).bit_length())
        out = frame.withColumn("_row", F.row_number().over(w)).withColumn("_blk", F.floor((F.col("_row") - 1) / self.block))
        block = Window.partitionBy(*keys, "_blk").orderBy(order)
        run, whole = running(block), block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        line = Window.partitionBy(*keys).orderBy("_blk", order)  # the block windows' own sort serves these too
        before = line.rowsBetween(Window.unboundedPreceding, -1)
        first = {f"_c_{n}": F.first(s.value, ignorenulls=True).over(whole) for n, s in series.items()}
        changes = {f"_p_{n}": F.last(s.value, ignorenulls=True).over(before) for n, s in series.items() if s.squares}
        out = out.withColumns({**first, **changes, "_at": F.col("_row") - F.col("_blk") * self.block})
        sums: dict[str, Column] = {}
        moved = {}
        for n, s in series.items():
            d = s.value - F.col(f"_c_{n}")
            sums[f"n_{n}"] = F.when(s.value.isNotNull(), F.lit(1.0))
            sums[f"s_{n}"] = d
            if s.squares:
                sums[f"q_{n}"] = d * d
                changed = s.value.isNotNull() & ~s.value.eqNullSafe(F.col(f"_p_{n}"))
                moved[f"_m_{n}"] = F.max(F.when(changed, F.col("_row"))).over(running(line))
            if s.ramp:
                sums[f"r_{n}"] = F.col("_at") * d
        totals = {f"{place}{k}": F.coalesce(F.sum(v).over(frame_), F.lit(0.0)) for k, v in sums.items() for place, frame_ in (("_", run), ("_t", whole))}
        out = out.withColumns({**totals, **moved})
        # plain columns, not one struct: those that no result needs are not carried
        held = ["_blk", *first, *totals]
        self.frame = out.withColumns({f"_lag_{k}_{c}": F.lag(c, k).over(line) for k in lengths for c in held})
        self._steps: list[dict[str, Column]] = [{}, {}]

    def _once(self, level: int, name: str, value: Column) -> Column:
        """A column that is worked out once a row, however many results are made of it."""
        self._steps[level][name] = value
        return F.col(name)

    def _parts(self, kind: str, name: str, length: int) -> tuple[Column, Column]:
        """Of a window: the sum over its rows in the present block, and over those in the one before."""
        key = f"{kind}_{name}"
        past, now = (lambda c: F.col(f"_lag_{length}_{c}")), F.col(f"_{key}")
        same = past("_blk") == F.col("_blk")
        here = F.when(same, now - past(f"_{key}")).otherwise(now)
        before = F.when(past("_blk").isNotNull() & ~same, past(f"_t{key}") - past(f"_{key}")).otherwise(0.0)
        return self._once(0, f"_here_{length}_{key}", here), self._once(0, f"_before_{length}_{key}", before)

    def _centre(self, name: str, length: int) -> tuple[Column, Column]:
        """The value that sums are about, and how far the earlier block's lies above it."""
        own, past = F.col(f"_c_{name}"), F.col(f"_lag_{length}__c_{name}")
        return F.coalesce(own, past, F.lit(0.0)), F.coalesce(past - own, F.lit(0.0))

    def count(self, name: str, length: int) -> Column:
        now, before = self._parts("n", name, length)
        return self._once(1, f"_count_{length}_{name}", now + before)

    def _sum(self, name: str, length: int) -> Column:
        (now, before), (_, m), (_, shift) = self._parts("s", name, length), self._parts("n", name, length), self._centre(name, length)
        return self._once(1, f"_sum_{length}_{name}", now + (before + m * shift))

    def total(self, name: str, length: int, min_periods: int) -> Column:
        n = self.count(name, length)
        return F.when(n >= min_periods, self._sum(name, length) + n * self._centre(name, length)[0])

    def mean(self, name: str, length: int, min_periods: int) -> Column:
        n = self.count(name, length)
        return F.when(n >= min_periods, ratio(self._sum(name, length), n) + self._centre(name, length)[0])

    def std(self, name: str, length: int, min_periods: int) -> Column:
        """Sample deviation; exactly zero when no value changed inside the window."""
        n, s = self.count(name, length), self._sum(name, length)
        (now, before), (_, part), (_, m), (_, shift) = self._parts("q", name, length), self._parts("s", name, length), self._parts("n", name, length), self._centre(name, length)
        q = now + (before + 2.0 * shift * part + m * shift * shift)
        spread = F.sqrt(F.greatest(F.lit(0.0), ratio(q - ratio(s * s, n), n - 1)))
        still = F.col(f"_m_{name}") <= F.col("_row") - (length - 1)
        return F.when((n >= max(2, min_periods)) & still, 0.0).when(n >= max(2, min_periods), spread)

    def z(self, name: str, length: int, min_periods: int) -> Column:
        gap = self.series[name].value - self.mean(name, length, min_periods)
        return ratio(gap, self.std(name, length, min_periods))

    def weighted(self, name: str, length: int) -> Column:
        """Linearly weighted mean, the newest value ``length`` times; NULL unless every row of the window has a value."""
        (r_now, r_before), (s_now, s_before), (_, m) = self._parts("r", name, length), self._parts("s", name, length), self._parts("n", name, length)
        centre, shift = self._centre(name, length)
        start = F.col("_at") - length
        ramp = (r_now - start * s_now) + (r_before - (start + self.block) * s_before + shift * m * (m + 1) / 2.0)
        return F.when(self.count(name, length) >= length, centre + ramp / (length * (length + 1) / 2.0))

    def select(self, columns: dict[str, Column]) -> DataFrame:
        """The input columns plus the given results; helper columns are dropped."""
        frame = self.frame
        for step in self._steps:
            frame = frame.withColumns(step) if step else frame
        return frame.select(*self._own, *[c.alias(n) for n, c in columns.items()])
