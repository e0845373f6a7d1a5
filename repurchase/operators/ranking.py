"""Global positions, running totals, exact quantiles and cuts without gathering a table in one task.

Positions of all rows need a sort: the rows are range-partitioned by the wanted order and written to the shared folder,
so that their assignment to partitions is fixed. Where only a few ranks are asked for (quantiles, cuts), nothing is
sorted: brackets around them are narrowed by drawn rows and counts until few rows are left. Running totals over numbers or
hashes take slices that the value itself names, so they need neither a sort over the cluster nor a stored step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repurchase.runtime import checkpointed, join_null_safe

_SLOT, _SLICE, _BEFORE = "_slot", "_slice", "_before"
# monotonically_increasing_id keeps the row number inside the partition in its lower 33 bits.
_ROW_BITS = 33


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row; ``order`` must be a total order."""
    ordered = checkpointed(df.orderBy(*order).withColumn(_SLOT, F.monotonically_increasing_id()))
    ordered = ordered.withColumn(_SLICE, F.shiftright(_SLOT, _ROW_BITS))
    # One row per range partition.
    sizes = ordered.groupBy(_SLICE).agg(F.count(F.lit(1)).alias(_BEFORE))
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_SLICE, F.coalesce(F.sum(_BEFORE).over(earlier), F.lit(0)).alias(_BEFORE))
    inside = F.col(_SLOT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = ordered.join(offsets, _SLICE).withColumn(name, F.col(_BEFORE) + inside + 1)
    return placed.drop(_SLOT, _SLICE, _BEFORE)


def running_totals(
    df: DataFrame, totals: dict[str, Column], order: Sequence[Column], within: Sequence[str] = ()
) -> DataFrame:
    """Add running totals (current row included) in a total order, separately per ``within`` group.

    ``within`` is for a handful of groups such as classes or table columns. A group of any size is
    spread over many partitions. Null is a group like any other.
    """
    within = list(within)
    valued = df.withColumns(totals)
    ranged = valued.repartitionByRange(*[F.col(c) for c in within], *order)
    sliced = checkpointed(ranged.withColumn(_SLICE, F.spark_partition_id()))
    # One row per range partition and group that occurs in it.
    sums = sliced.groupBy(*within, _SLICE).agg(*[F.sum(t).alias(t) for t in totals])
    earlier = Window.partitionBy(*within).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *within, _SLICE, *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"{_BEFORE}_{t}") for t in totals]
    )
    inside = Window.partitionBy(*within, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = join_null_safe(sliced, offsets, [*within, _SLICE])
    running = {t: F.col(f"{_BEFORE}_{t}") + F.sum(t).over(inside) for t in totals}
    return summed.withColumns(running).drop(_SLICE, *[f"{_BEFORE}_{t}" for t in totals])


# Rows of a bracket that are gathered to read off the ranks inside.
FEW = 1 << 15
# Rows drawn to propose values: a hundredth of a bracket, but no fewer and no more than these.
DRAWN = (50_000, 1_000_000)


@dataclass(frozen=True)
class _Bracket:
    """Ranks, counted from 0, among the ``size`` rows of a column strictly between two values."""

    column: str
    low: Any
    high: Any
    size: int
    ranks: tuple[int, ...]
    # Rank of the first row inside the bracket, among all rows of the column.
    start: int

    @property
    def inside(self) -> Column:
        c = F.col(self.column)
        bounds = [c > F.lit(self.low)] if self.low is not None else []
        bounds += [c < F.lit(self.high)] if self.high is not None else []
        return reduce(lambda a, b: a & b, bounds) if bounds else c.isNotNull()

    @property
    def share(self) -> float:
        """How much of the bracket is drawn."""
        return min(1.0, max(DRAWN[0], min(DRAWN[1], self.size / 100)) / self.size)

    def proposals(self, kind: T.DataType) -> Column:
        """Aggregate over drawn rows: values that are likely to enclose each rank."""
        value = F.when(self.inside, F.col(self.column))
        if isinstance(kind, T.NumericType):
            # Four standard deviations to both sides.
            slack = 2.0 / math.sqrt(self.size * self.share)
            places = {min(1.0, max(0.0, r / (self.size - 1) + d)) for r in self.ranks for d in (-slack, slack)}
            return F.percentile_approx(value, sorted(places))
        if isinstance(kind, (T.StringType, T.DateType)):
            # Random values: the smallest by different hashes.
            return F.array(*[F.min_by(value, F.when(value.isNotNull(), F.xxhash64(value, F.lit(i)))) for i in range(32)])
        raise TypeError(f"{self.column}: ranks of {kind.simpleString()} are not supported")

    def edges(self, proposed: Sequence[Any] | None) -> list[Any]:
        """The values to count at, in order: those strictly inside."""
        kept = {v for v in proposed or () if v is not None and (self.low is None or v > self.low) and (self.high is None or v < self.high)}
        return sorted(kept)

    def part(self, low: Any, high: Any, before: int, below: int) -> list[_Bracket]:
        """The bracket of the rows numbered ``before`` to ``below``, if a rank lies there."""
        mine = tuple(r - before for r in self.ranks if before <= r < below)
        return [_Bracket(self.column, low, high, below - before, mine, self.start + before)] if mine else []


def ranked_values(df: DataFrame, ranks: dict[str, Sequence[int]], sizes: dict[str, int], with_each: Sequence[str] = ()) -> dict[str, dict[int, Any]]:
    """The values that hold the given ranks (from 0, ascending) among the non-null values of each column.

    Drawn rows propose values around every rank, and counts say between which of them it lies: a rank that falls on one
    is found, however often the value occurs; for the others the bracket narrows, by a factor of 50 to 250 a round.
    Brackets of at most ``FEW`` rows are gathered. A step is one aggregation for all brackets at once: a table of a
    million rows takes three scans, one of 10**11 rows seven. Nothing is sorted or shuffled but partial aggregates,
    and what is drawn decides about speed only.
    """
    found: dict[str, dict[int, Any]] = {c: {} for c in ranks}
    todo = [_Bracket(c, None, None, sizes[c], tuple(sorted(set(r))), 0) for c, r in ranks.items() if r]
    while todo:
        small, large = [b for b in todo if b.size <= FEW], [b for b in todo if b.size > FEW]
        if small:
            gathered = df.agg(*[F.sort_array(F.collect_list(F.when(b.inside, F.col(b.column)))) for b in small]).first()
            for b, values in zip(small, gathered):
                found[b.column] |= {b.start + r: values[r] for r in b.ranks}
        if not large:
            break
        drawn = df.sample(max(b.share for b in large), 17)
        edges = [b.edges(v) for b, v in zip(large, drawn.agg(*[b.proposals(df.schema[b.column].dataType) for b in large]).first())]
        # Nothing drawn, or whole numbers too long for the sketch: the ends and the middle.
        missed = [i for i, values in enumerate(edges) if not values]
        if missed:
            ends = df.agg(*[f(F.when(large[i].inside, F.col(large[i].column))) for i in missed for f in (F.min, F.max)]).first()
            for i, least, most in zip(missed, ends[::2], ends[1::2]):
                edges[i] = sorted({least, most, *([(least + most) // 2] if isinstance(least, int) else [])})
        counts = [F.count(F.when(b.inside & c if b.low is not None else c, 1)) for b, values in zip(large, edges) for v in values for c in (F.col(b.column) < F.lit(v), F.col(b.column) <= F.lit(v))]
        told = iter(df.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts)]).first() if counts else ())
        todo = []
        for b, values in zip(large, edges):
            low, before = b.low, 0
            for v in values:
                below, upto = next(told), next(told)
                todo += b.part(low, v, before, below)
                found[b.column] |= {b.start + r: v for r in b.ranks if below <= r < upto}
                low, before = v, upto
            todo += b.part(low, b.high, before, b.size)
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Interpolated quantiles of the non-null values of each column, found by narrowing brackets.

    Returns column_name, quantiles (array, one entry per probability); a column without values has no row.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    sizes = values.agg(*[F.count(c).alias(c) for c in columns]).first().asDict() if columns else {}
    exact = {c: [(n - 1) * p for p in probabilities] for c, n in sizes.items() if n}
    ranks = {c: [r for at in places for r in (math.floor(at), math.ceil(at))] for c, places in exact.items()}
    found = ranked_values(values, ranks, sizes)
    rows = []
    for c, places in exact.items():
        ends = [(found[c][math.floor(at)], found[c][math.ceil(at)], at - math.floor(at)) for at in places]
        rows.append((c, [low if low == high else low + (high - low) * share for low, high, share in ends]))
    return df.sparkSession.createDataFrame(rows, "column_name string, quantiles array<double>")


def comparable(df: DataFrame, c: str) -> Column:
    """The column, null where it is NaN."""
    return F.when(~F.isnan(c), F.col(c)) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)


def cut_rows(df: DataFrame, score: str, tie: str, counts: Sequence[int], descending: bool = True) -> dict[int, tuple[Any, Any] | None]:
    """For each n the (score, tie) of the n-th row by score, equal scores in order of the unique ``tie``.

    Rows without score (null or NaN) come last, in order of ``tie``; None where there are fewer than n rows (or n is 0).
    Brackets on the score find the score, and among the rows that share it brackets on the tie find the row.
    """
    keys = df.select(comparable(df, score).alias("_score"), F.col(tie).alias("_tie")).persist()
    try:
        rows, scored, untied = keys.agg(F.count("*"), F.count("_score"), F.count_if(F.col("_tie").isNull())).first()
        if untied:
            raise ValueError(f"{untied} rows have no {tie}")
        wanted = sorted({n for n in counts if 0 < n <= rows})
        place = {n: scored - n if descending else n - 1 for n in wanted if n <= scored}
        values = ranked_values(keys, {"_score": list(place.values())}, {"_score": scored})["_score"]
        at = {n: values[p] for n, p in place.items()}
        better = F.col("_score").__gt__ if descending else F.col("_score").__lt__
        distinct = list(dict.fromkeys(at.values()))
        told = keys.agg(*[F.count(F.when(c, 1)) for v in distinct for c in (better(F.lit(v)), F.col("_score") == F.lit(v))]).first() if distinct else ()
        before = {v: (told[2 * i], told[2 * i + 1]) for i, v in enumerate(distinct)}
        cuts: dict[int, tuple[Any, Any] | None] = {n: None for n in counts}
        # Rows without score follow all others.
        groups = [(v, F.col("_score") == F.lit(v), *before[v]) for v in distinct]
        groups.append((None, F.col("_score").isNull(), scored, rows - scored))
        ranks, sizes, equal = {}, {}, {}
        for i, (v, same, first, size) in enumerate(groups):
            mine = {n: n - first - 1 for n in wanted if first < n <= first + size and at.get(n) == v}
            if mine:
                ranks[f"_{i}"], sizes[f"_{i}"], equal[f"_{i}"] = list(mine.values()), size, (v, mine, same)
        ties = keys.select(*[F.when(same, F.col("_tie")).alias(name) for name, (_, _, same) in equal.items()]) if equal else keys
        found = ranked_values(ties, ranks, sizes)
        for name, (v, mine, _) in equal.items():
            cuts |= {n: (v, found[name][r]) for n, r in mine.items()}
        return cuts
    finally:
        keys.unpersist()


def upto_cut(df: DataFrame, score: str, tie: str, cut: tuple[Any, Any], descending: bool = True) -> Column:
    """Whether a row of ``df`` is the one of ``cut`` or comes before it, in the order of :func:`cut_rows`."""
    value, last = cut
    s, t = comparable(df, score), F.col(tie)
    if value is None:
        return s.isNotNull() | (t <= F.lit(last))
    better = s > F.lit(value) if descending else s < F.lit(value)
    return F.coalesce(better | ((s == F.lit(value)) & (t <= F.lit(last))), F.lit(False))


# --- slices named by the value -----------------------------------------------------------------

SLICES = 1 << 17


def number_slice(c: Column, slices: int = SLICES) -> Column:
    """A whole number that never falls where the value rises, with about equal relative width everywhere.

    Roots and reciprocals are rounded correctly, so equal and neighbouring values keep their order.
    """
    size = F.abs(c.cast("double"))
    root = lambda x: F.sqrt(F.sqrt(F.sqrt(x)))
    image = F.when(size <= 1, root(size)).otherwise(F.lit(2.0) - root(F.lit(1.0) / size))
    return F.floor(F.signum(c.cast("double")) * image * F.lit(float(slices)))


def sliced_totals(
    df: DataFrame, totals: dict[str, Column], order: Sequence[Column], slice_: Column, within: Sequence[str] = ()
) -> DataFrame:
    """As :func:`running_totals`, for rows whose value itself names their slice: one lazy plan, nothing stored.

    ``slice_`` must rise with ``order``. The sums of slices, at most one row per slice and group, are added up in one
    task per group.
    """
    within = list(within)
    valued = df.withColumns({**totals, _SLICE: slice_})
    sums = valued.groupBy(*within, _SLICE).agg(*[F.sum(t).alias(t) for t in totals])
    earlier = Window.partitionBy(*within).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *within, _SLICE, *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"{_BEFORE}_{t}") for t in totals]
    )
    inside = Window.partitionBy(*within, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = valued.withColumns({f"{_SLICE}_{t}": F.sum(t).over(inside) for t in totals})
    summed = join_null_safe(placed, offsets, [*within, _SLICE])
    running = {t: F.col(f"{_BEFORE}_{t}") + F.col(f"{_SLICE}_{t}") for t in totals}
    return summed.withColumns(running).drop(_SLICE, *[f"{x}_{t}" for t in totals for x in (_BEFORE, _SLICE)])


def top_n(df: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows with the highest scores, for reports; equal scores in order of ``tie``."""
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(n)
