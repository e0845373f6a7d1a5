"""Aggregates over trailing day windows of one row per customer and day.

``age`` is the number of days from a row's day to the reference date. Window ``i`` shifted by ``s``
covers ages s+1 … s+i; days without a row count as value 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DayWindow:
    value: Column
    age: Column
    length: int
    shift: int = 0

    @property
    def _inside(self) -> Column:
        return self.age.between(self.shift + 1, self.shift + self.length)

    @property
    def _seen(self) -> Column:
        return F.when(self._inside, self.value)

    def _with_empty_days(self, extreme, pick) -> Column:
        seen = extreme(self._seen)
        return F.when(F.count(self._seen) < self.length, pick(F.coalesce(seen, F.lit(0.0)), F.lit(0.0))).otherwise(seen)

    def sum(self) -> Column:
        return F.coalesce(F.sum(self._seen), F.lit(0.0))

    def mean(self) -> Column:
        return self.sum() / F.lit(self.length)

    def max(self) -> Column:
        return self._with_empty_days(F.max, F.greatest)

    def min(self) -> Column:
        return self._with_empty_days(F.min, F.least)

    def decay_sum(self, rate: float) -> Column:
        weight = F.pow(F.lit(rate), self.age - (self.shift + 1))
        return F.coalesce(F.sum(F.when(self._inside, self.value * weight)), F.lit(0.0))

    def std(self) -> Column:
        """Sample standard deviation over all days of the window.

        The days seen and the empty ones are combined as two samples, so large values lose no digits.
        """
        n, mean = F.count(self._seen), F.coalesce(F.avg(self._seen), F.lit(0.0))
        inner = F.coalesce(F.var_pop(self._seen), F.lit(0.0)) * n
        between = mean * mean * n * (F.lit(self.length) - n) / F.lit(self.length)
        return F.sqrt((inner + between) / F.lit(self.length - 1))

    def median(self) -> Column:
        """Median over all days.

        All windows of a measure take their values from one collected list of at most one entry per day.
        """
        days = F.collect_list(F.struct(self.age.alias("age"), self.value.alias("value")))
        inside = F.filter(days, lambda d: d["age"].between(self.shift + 1, self.shift + self.length))
        seen = F.transform(F.filter(inside, lambda d: d["value"].isNotNull()), lambda d: d["value"])
        days = F.array_sort(F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(self.length) - F.size(seen))))
        return (F.element_at(days, (self.length + 1) // 2) + F.element_at(days, self.length // 2 + 1)) / 2

    def diff_mean(self) -> Column:
        """Mean day-to-day difference: the inner terms cancel, the two end days remain."""
        newest = F.sum(F.when(self.age == self.shift + 1, self.value))
        oldest = F.sum(F.when(self.age == self.shift + self.length, self.value))
        return (F.coalesce(newest, F.lit(0.0)) - F.coalesce(oldest, F.lit(0.0))) / F.lit(self.length - 1)

    def active_days(self, active: Column) -> Column:
        return F.count(F.when(self._inside & active, F.lit(1))).cast("int")

    def days_since_last(self, active: Column) -> Column:
        """Age of the newest active day; the window length when there is none."""
        return F.coalesce(F.min(F.when(self._inside & active, self.age - self.shift)), F.lit(self.length)).cast("int")

    def days_since_first(self, active: Column) -> Column:
        """Age of the oldest active day; 0 when there is none."""
        return F.coalesce(F.max(F.when(self._inside & active, self.age - self.shift)), F.lit(0)).cast("int")
