"""Orders over several columns as one number.

``max(struct(order, value))`` needs a sort, as a struct has no fixed width in an aggregation buffer. A number has: with
the order packed into one, "last value" is ``max_by`` of fixed-width columns and runs as a hash aggregate.

The columns become digits of a mixed radix, each as wide as the values that occur need: a long where all fit, else a
decimal of 38 digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_EPOCH = "1970-01-01 00:00:00"
# Units of time from wide to narrow, with their microseconds.
_UNITS = (("DAY", 86_400_000_000), ("SECOND", 1_000_000), ("MICROSECOND", 1))
_LONG, _DECIMAL = 1 << 62, 10**38


@dataclass(frozen=True)
class Span:
    """Smallest and largest value of a column, as whole numbers of its unit; ``unit`` is set for times."""

    low: int
    high: int
    unit: str | None = None

    @property
    def size(self) -> int:
        # Null is a value of its own, below all others.
        return self.high - self.low + 2


def _image(c: Column, kind: T.DataType, unit: str | None = None) -> Column:
    """The value as a whole number: of units since 1970 for times."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff(unit or "MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c)
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c) if unit == "SECOND" else F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("long")


def _packable(kind: T.DataType) -> bool:
    return isinstance(kind, (*_WHOLE, *_FLOATING, T.TimestampNTZType, T.TimestampType, T.DateType))


def _measures(df: DataFrame, columns: Sequence[str]) -> Column:
    """Aggregate: per column its name, smallest and largest image, and whether all values are multiples of two units."""
    entries = []
    for c in columns:
        kind = df.schema[c].dataType
        value, image = F.col(c), _image(F.col(c), kind)
        if isinstance(kind, _FLOATING):
            first = second = F.bool_and((value == F.rint(value)) & (F.abs(value) < float(1 << 53)))
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            first, second = (F.bool_and(image % F.lit(width) == 0) for _, width in _UNITS[:2])
        else:
            first = second = F.lit(True)
        entries.append(F.struct(F.lit(c).alias("c"), F.min(image).alias("low"), F.max(image).alias("high"), first.alias("first"), second.alias("second")))
    return F.array(*entries)


def spans(df: DataFrame, columns: Sequence[str], *more: tuple[DataFrame, Sequence[str]]) -> dict[str, Span]:
    """The spans of those columns that can be packed, from one scan without shuffle, or one each of several tables.

    Times take the widest unit of which all values are multiples (days, seconds, microseconds). Floating-point columns
    can be packed if they hold whole numbers only.
    """
    parts, kinds = [], {}
    for table, names in ((df, columns), *more):
        asked = [c for c in names if _packable(table.schema[c].dataType)]
        kinds |= {c: table.schema[c].dataType for c in asked}
        if asked:
            parts.append(table.agg(_measures(table, asked).alias("r")))
    out = {}
    rows = [e for r in reduce(DataFrame.unionByName, parts).collect() for e in r.r] if parts else []
    for c, low, high, first, second in rows:
        if low is None:
            out[c] = Span(0, 0)
        elif isinstance(kinds[c], (T.TimestampNTZType, T.TimestampType)):
            # Days of a timestamp with a time zone are not of equal length.
            days = first and isinstance(kinds[c], T.TimestampNTZType)
            unit, width = _UNITS[0 if days else 1 if second else 2]
            out[c] = Span(low // width, high // width, unit)
        elif first:
            out[c] = Span(low, high)
    return out


def merged(*parts: dict[str, Span]) -> dict[str, Span]:
    """Spans that hold all values of several tables; a column missing in one of them keeps what the others say."""
    out: dict[str, Span] = {}
    for part in parts:
        for c, span in part.items():
            have = out.get(c, span)
            if have.unit != span.unit:
                width = dict(_UNITS)
                unit = min((have.unit, span.unit), key=lambda u: width[u])
                have, span = (Span(s.low * (width[s.unit] // width[unit]), s.high * (width[s.unit] // width[unit]), unit) for s in (have, span))
            out[c] = Span(min(have.low, span.low), max(have.high, span.high), have.unit)
    return out


def packed(df: DataFrame, order: Sequence[str], known: dict[str, Span]) -> Column | None:
    """One number that orders rows like the struct of ``order`` does, nulls first; None if 38 digits do not hold it.

    A value outside its span is an error, never a wrong order.
    """
    if any(c not in known for c in order) or prod(known[c].size for c in order) > _DECIMAL:
        return None
    groups: list[tuple[Column, int]] = []
    for c in order:
        span, image = known[c], _image(F.col(c), df.schema[c].dataType, known[c].unit)
        outside = F.raise_error(F.concat(F.lit(f"{c} is outside the span that was measured: "), F.col(c).cast("string")))
        kind = "long" if span.size < _LONG else "decimal(38,0)"
        digit = F.when(image.isNull(), F.lit(0).cast(kind)).when(
            image.between(span.low, span.high), image.cast(kind) - F.lit(str(span.low - 1)).cast(kind)
        ).otherwise(outside.cast(kind))
        if groups and groups[-1][1] * span.size < _LONG:
            before, size = groups[-1]
            groups[-1] = (before * F.lit(span.size) + digit, size * span.size)
        else:
            groups.append((digit, span.size))
    key = groups[0][0]
    for digit, size in groups[1:]:
        key = (key.cast("decimal(38,0)") * F.lit(str(size)).cast("decimal(38,0)")).cast("decimal(38,0)") + digit.cast("decimal(38,0)")
        key = key.cast("decimal(38,0)")
    return key


def last_value(value: str, key: Column) -> Column:
    """Aggregate: the non-null ``value`` with the largest key; keys must not repeat within a group."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), key))
