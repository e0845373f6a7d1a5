"""Casts, filling of missing values, and narrowing of column types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repurchase.functions import expressions as X
from repurchase.schema import FLAG_COLUMNS, ID_COLUMNS, TIME_COLUMNS
from repurchase.sources.storage import Statistics

_FLOATING = (T.FloatType, T.DoubleType)
# Largest absolute deviation from whole numbers, summed over a column, that still counts as integer.
INTEGER_TOLERANCE = 0.01


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]


def _is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _FLOATING)


def cast_ids(df: DataFrame, columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns if c in df.columns})


def clean_flags(df: DataFrame, columns: Sequence[str] = FLAG_COLUMNS) -> DataFrame:
    """Status flags as small integers, 0 where missing."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in columns if c in df.columns})


def parse_times(df: DataFrame, columns: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    """Timestamps from ``yyyy-MM-dd HH:mm:ss`` text, null where the text is none."""
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in columns})


def to_day(df: DataFrame, columns: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.to_date(c) for c in columns})


def fill_const(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns({c: X.fill(c, v) for c, v in values.items()})


def column_means(df: DataFrame, columns: Sequence[str], decimals: int | None = None) -> dict[str, float | None]:
    """Mean of each column. One scan; the driver receives one row."""
    row = df.agg(*[X.mean(c, decimals).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def fill_mean(
    df: DataFrame, columns: Sequence[str] | None = None, decimals: int | None = None, known: Statistics | None = None
) -> DataFrame:
    """Numeric nulls replaced by the column mean; ``known`` statistics of the table spare the scan."""
    columns = list(columns if columns is not None else numeric_columns(df))
    means = {c: known.mean(c) for c in columns} if known else column_means(df, columns, decimals)
    return fill_const(df, {c: mean for c, mean in means.items() if mean is not None})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the most frequent value, the smallest one on a tie.

    One scan counts the values of all columns, so no task holds all values of a column; the driver gets
    one value per column.
    """
    columns = list(columns)
    kinds = {f.name: f.dataType for f in df.schema}

    def cell(at: int, c: str) -> Column:
        number = F.col(c).cast("double") if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("double")
        return F.struct(F.lit(at).alias("at"), F.col(c).cast("string").alias("text"), number.alias("number"))

    if not columns:
        return df
    cells = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).where("text is not null")
    counts = cells.groupBy("at", "text", "number").agg(F.count("*").alias("n"))
    most = counts.groupBy("at").agg(F.min_by("text", F.struct(-F.col("n"), "number", "text")).alias("text"))
    return fill_const(df, {columns[r["at"]]: F.lit(r["text"]).cast(kinds[columns[r["at"]]]) for r in most.collect()})


def clean_inf(df: DataFrame, columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """NaN and both infinities as null, and nulls as ``fill`` unless that is None."""
    finite = {c: F.when(~(F.isnan(c) | X.is_infinite(c)), F.col(c)) for c in columns}
    if fill is not None:
        finite = {c: X.fill(v, fill) for c, v in finite.items()}
    return df.withColumns(finite)


# Largest finite value of a float.
FLOAT_MAX = 3.4028234663852886e38
# Whole-number types with the range they hold, narrowest first.
_WHOLE_TYPES = (("byte", 2**7), ("short", 2**15), ("int", 2**31), ("long", 2**63))


def _target_type(low: Column, high: Column, whole: Column) -> Column:
    choice = F.lit("double")
    for name, bound in reversed(_WHOLE_TYPES):
        # As doubles: the bound itself is exact, the number before it may not be.
        fits = whole & (low >= F.lit(float(-bound))) & (high < F.lit(float(bound)))
        choice = F.when(fits, F.lit(name)).otherwise(choice)
    small = (low >= F.lit(-FLOAT_MAX)) & (high <= F.lit(FLOAT_MAX))
    return F.when(~whole & small, F.lit("float")).when(~whole, F.lit("double")).otherwise(choice)


def range_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: min, max, whether all values are whole, nulls, non-finite values, target type.

    One scan. Non-finite values take no part in range and whole-number test.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    measures = []
    for c in columns:
        floating = _is_floating(df, c)
        value = F.col(c).cast("double")
        finite = F.when(~X.non_finite(value), value)
        # A value outside the range of long has no fraction left.
        off = F.coalesce(F.abs(finite - finite.try_cast("long")), F.lit(0.0))
        measures.append(
            F.struct(
                F.lit(c).alias("column_name"),
                (F.min(finite) + F.lit(0.0)).alias("min"),
                (F.max(finite) + F.lit(0.0)).alias("max"),
                (F.coalesce(F.sum(off), F.lit(0.0)) < INTEGER_TOLERANCE).alias("is_int"),
                F.count(F.when(F.col(c).isNull(), 1)).alias("null_count"),
                F.count(F.when(X.non_finite(c, floating), 1)).alias("non_finite_count"),
            )
        )
    report = df.agg(F.array(*measures).alias("r")).select(F.inline("r"))
    return report.withColumn("target_type", _target_type(F.col("min"), F.col("max"), F.col("is_int")))


def non_finite_columns(report: DataFrame) -> DataFrame:
    """Names of the columns in a range report that had null, NaN or infinite values."""
    return report.where(F.col("non_finite_count") > 0).select("column_name")


def known_report(df: DataFrame, known: Statistics, columns: Sequence[str] | None = None) -> DataFrame:
    """As :func:`range_report`, from statistics stored with the table instead of a scan."""
    columns = list(columns if columns is not None else numeric_columns(df))
    rows = []
    for c in columns:
        low, high = known.of(c, "finite_min"), known.of(c, "finite_max")
        whole = known.of(c, "off") < INTEGER_TOLERANCE
        nulls = known.nulls(c)
        rows.append((c, None if low is None else low + 0.0, None if high is None else high + 0.0, whole, nulls, known.rows - known.of(c, "finite")))
    kinds = "column_name string, min double, max double, is_int boolean, null_count long, non_finite_count long"
    report = df.sparkSession.createDataFrame(rows, kinds)
    return report.withColumn("target_type", _target_type(F.col("min"), F.col("max"), F.col("is_int")))


def narrow_types(
    df: DataFrame, columns: Sequence[str] | None = None, known: Statistics | None = None
) -> tuple[DataFrame, DataFrame]:
    """Each numeric column in the narrowest type that holds its range, and the report behind the choice.

    ``known`` statistics of the table spare the scan. Nulls stay null. A whole-number column loses NaN and infinities to null, as no integer can hold them.
    The report has one row per column and is read by the driver to build the projection.
    """
    report = known_report(df, known, columns) if known else range_report(df, columns)
    casts = {}
    for row in report.collect():
        c, target = row["column_name"], row["target_type"]
        kept = F.col(c)
        if _is_floating(df, c) and target not in ("float", "double"):
            kept = F.when(~X.non_finite(kept), F.rint(kept))
        casts[c] = kept.cast(target)
    return df.withColumns(casts), report
