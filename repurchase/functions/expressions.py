"""Scalar and aggregate column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- missing and non-finite values -------------------------------------------------------------


def is_infinite(c: str | Column) -> Column:
    return F.abs(column(c)) == F.lit(INFINITY)


def non_finite(c: str | Column, floating: bool = True) -> Column:
    """True for null and, in floating-point columns, for NaN and both infinities."""
    missing = column(c).isNull()
    return missing | F.isnan(column(c)) | is_infinite(c) if floating else missing


def finite(c: str | Column) -> Column:
    return ~non_finite(c)


def whole(c: str | Column) -> Column:
    """The number without its fraction; null where no long can hold it."""
    return column(c).try_cast("long")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0."""
    return F.when(condition, 1).otherwise(0)


def one_if_positive(c: str | Column) -> Column:
    """1 for positive values, any other value as it is."""
    return F.when(column(c) > 0, F.lit(1.0)).otherwise(column(c))


def any_null(c: str | Column) -> Column:
    """Aggregate: whether any value is null."""
    return F.coalesce(F.bool_or(column(c).isNull()), F.lit(False))


def fill(c: str | Column, value) -> Column:
    return F.coalesce(column(c), F.lit(value))


# --- dates -------------------------------------------------------------------------------------


def as_timestamp(value: str | date | datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def as_date(value: str | date) -> Column:
    return F.lit(str(value)).cast("date")


def day_of(value: str | date | Column) -> Column:
    """A date, given as a column or as a value."""
    return value if isinstance(value, Column) else as_date(value)


def days_since(epoch: str | date, c: str | Column) -> Column:
    """Whole days from midnight of ``epoch``, rounded down."""
    return F.datediff(F.to_date(column(c)), as_date(epoch))


def month_number(c: str | Column) -> Column:
    """Year and month as yyyymm."""
    return F.year(column(c)) * 100 + F.month(column(c))


def calendar_from(first: Column, days: int) -> Column:
    """Array of ``days`` consecutive dates."""
    return F.sequence(first, F.date_add(first, days - 1))


def calendar(first: str | date, days: int) -> Column:
    return calendar_from(as_date(first), days)


def time_parts(c: str | Column, prefix: str) -> list[Column]:
    """Month, day, hour, minute, second and weekday (Monday is 0)."""
    t = column(c)
    return [
        F.month(t).alias(f"{prefix}_m"),
        F.dayofmonth(t).alias(f"{prefix}_d"),
        F.hour(t).alias(f"{prefix}_h"),
        F.minute(t).alias(f"{prefix}_min"),
        F.second(t).cast("int").alias(f"{prefix}_s"),
        F.weekday(t).alias(f"{prefix}_weekday"),
    ]


# --- last values -------------------------------------------------------------------------------


def latest(value: str, order: Sequence[str]) -> Column:
    """Aggregate: last non-null ``value`` in ``order``.

    The value closes the ordering struct, so equal orderings still give one defined answer, and the
    aggregate is combined before the shuffle however many rows a customer has.
    """
    entry = F.struct(*order, F.col(value).alias("_value"))
    return F.max(F.when(F.col(value).isNotNull(), entry)).getField("_value")


def latest_row(values: Sequence[str], order: Sequence[str]) -> Column:
    """Aggregate: the ``values`` of the last row in ``order``, as one struct.

    One ordering key for all columns instead of one each; equals :func:`latest` per column as long as
    the last row holds no null in them.
    """
    return F.max(F.struct(F.struct(*order).alias("_order"), F.struct(*values).alias("_row"))).getField("_row")


def present(c: Column, name: str) -> Column:
    """``c``, or an error where it is null although ``name`` was declared free of nulls."""
    message = F.lit(f"{name} holds nulls: list it in SnapshotSpec.nullable")
    return F.when(c.isNull(), F.raise_error(message)).otherwise(c)


# --- sums --------------------------------------------------------------------------------------


def _sum(c: str | Column, decimals: int | None) -> Column:
    if decimals is None:
        return F.sum(column(c).cast("double"))
    # Decimals, as a sum over very many rows leaves the range of long.
    return F.sum(F.rint(column(c) * float(10**decimals)).cast("decimal(20,0)")).cast("double") / float(10**decimals)


def total(c: str | Column, decimals: int | None = None) -> Column:
    """Aggregate: sum, 0 when there is nothing to add.

    With ``decimals`` the addition runs on whole units of 10**-decimals, so that the result does not
    depend on how rows were partitioned.
    """
    return F.coalesce(_sum(c, decimals), F.lit(0.0))


def mean(c: str | Column, decimals: int | None = None) -> Column:
    """Aggregate: mean of the non-null values, null when there are none.

    Written as sum over count, so that it shares its sum with :func:`total` of the same column.
    """
    return F.try_divide(_sum(c, decimals), F.count(column(c)))


def spread(c: str, decimals: int | None = None) -> list[Column]:
    """Aggregates: mean, sample standard deviation (null for one value), maximum, minimum."""
    return [
        mean(c, decimals).alias(f"{c}_mean"),
        F.stddev_samp(c).alias(f"{c}_std"),
        F.max(c).alias(f"{c}_max"),
        F.min(c).alias(f"{c}_min"),
    ]


def level(c: str, prefix: str, decimals: int | None = None) -> list[Column]:
    """Aggregates: mean and sum."""
    return [mean(c, decimals).alias(f"{prefix}_mean"), total(c, decimals).alias(f"{prefix}_sum")]


# --- vectors -----------------------------------------------------------------------------------


def distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two arrays."""
    squares = F.zip_with(column(a), column(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))
