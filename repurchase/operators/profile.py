"""Table profiles: types, counts, numeric and categorical summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.operators.clean import numeric_columns, text_columns
from repurchase.operators.ranking import exact_quantiles
from repurchase.sources.storage import Statistics

QUARTILES = (0.25, 0.5, 0.75)


def _per_column(df: DataFrame, structs: list) -> DataFrame:
    """One row per struct of aggregates, all computed in one scan."""
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def profile_schema(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of each column."""
    return _per_column(
        df,
        [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("dtype"),
                F.count(name).alias("non_null"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ],
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None, known: Statistics | None = None) -> DataFrame:
    """Nulls of each column; ``known`` statistics of the table spare the scan."""
    if known:
        rows = [(c, known.nulls(c)) for c in columns or df.columns]
        return df.sparkSession.createDataFrame(rows, "column_name string, count_null long")
    return _per_column(
        df,
        [
            F.struct(F.lit(c).alias("column_name"), F.count(F.when(F.col(c).isNull(), 1)).alias("count_null"))
            for c in columns or df.columns
        ],
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample standard deviation, min, quartiles, max of each numeric column.

    Exact quartiles take a few scans, as brackets around them narrow; ``exact=False`` uses Spark's sketch instead and
    needs only one.
    """
    columns = list(columns or numeric_columns(df))
    structs = []
    for c in columns:
        value = F.col(c).cast("double")
        entry = [
            F.lit(c).alias("column_name"),
            F.count(c).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            (F.min(value) + F.lit(0.0)).alias("min"),
            (F.max(value) + F.lit(0.0)).alias("max"),
        ]
        if not exact:
            entry.append(F.percentile_approx(value, list(QUARTILES)).alias("quantiles"))
        structs.append(F.struct(*entry))
    stats = _per_column(df, structs)
    if exact:
        # Both sides have one row per column.
        stats = stats.join(exact_quantiles(df, columns, QUARTILES), "column_name", "left")
    quartiles = [F.col("quantiles")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    return stats.select("column_name", "count", "mean", "std", "min", *quartiles, "max")


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, number of different values, most frequent value and its count, first and last value.

    Values are counted per column and value first; the most frequent value is the smallest on a tie.
    """
    columns = list(columns or text_columns(df))
    # A column without any value keeps its null entry and so appears with count 0.
    cells = df.select(F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("at", "value"))
    counted = cells.groupBy("at", "value").agg(F.count("*").alias("rows"))
    counted = counted.withColumn("n", F.when(F.col("value").isNotNull(), F.col("rows")))
    common = F.when(F.col("n").isNotNull(), F.struct(-F.col("n"), F.col("value")))
    summary = counted.groupBy("at").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
        F.min_by("value", common).alias("top"),
        F.max("n").alias("freq"),
        F.min("value").alias("first"),
        F.max("value").alias("last"),
    )
    return summary.withColumn("column_name", F.get(F.array(*[F.lit(c) for c in columns]), F.col("at"))).drop("at")


def summary_table(df: DataFrame, exact: bool = True) -> DataFrame:
    """Numeric and categorical summaries with null counts, one row per column, ordered by type."""
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    numbers, texts = numeric_columns(df), text_columns(df)
    parts = [describe_numeric(df, numbers, exact).drop("mean", "std")] if numbers else []
    parts += [describe_categorical(df, texts)] if texts else []
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    joined = merged.join(null_counts(df), "column_name").withColumn("dtype", kinds[F.col("column_name")])
    order = ["column_name", "dtype", "count", "count_null", "unique", "min", "max", "p25", "p50", "p75"]
    order += ["top", "freq", "first", "last"]
    return joined.select(*[c for c in order if c in joined.columns]).orderBy("dtype", "column_name")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each non-null value occurs, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), column)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def time_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))
