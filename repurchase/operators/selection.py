"""Feature scores against a label, selection of the best, vector assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repurchase.operators.clean import column_means
from repurchase.operators.ranking import exact_quantiles
from repurchase.operators.scaling import value_ranges


def _long(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One row per labelled row and feature: class, position of the feature, value; nulls as the mean.

    A feature is one expression here whatever the width of the table, and grouping by class and
    position is combined before the shuffle down to a row per class and feature.
    """
    rows = df.where(F.col(label).isNotNull())
    means = column_means(rows, columns)
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("at", "value")
    cells = rows.select(F.col(label).alias("class"), cells)
    return cells.withColumn("value", F.coalesce("value", _by_position([means[c] for c in columns])))


def _by_position(values: Sequence, kind: str = "double") -> Column:
    """The entry of ``values`` that belongs to the feature of a long row."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("at"))


def anova_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way F statistic of each feature over the classes; nulls count as the column mean."""
    cells = _long(df, columns, label)
    per_class = cells.groupBy("at", "class").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )
    # From here on one row per class and feature.
    feature = Window.partitionBy("at")
    grand = F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature)
    per_class = per_class.withColumn("between", F.col("n") * F.pow(F.col("mean") - grand, F.lit(2.0)))
    within = (F.col("n") - 1) * F.coalesce("var", F.lit(0.0))
    sums = per_class.groupBy("at").agg(
        F.sum("between").alias("ssb"),
        F.sum(within).alias("ssw"),
        F.count("*").alias("classes"),
        F.sum("n").alias("rows"),
    )
    ratio = F.try_divide(
        F.try_divide(F.col("ssb"), F.col("classes") - 1), F.try_divide(F.col("ssw"), F.col("rows") - F.col("classes"))
    )
    return sums.select(_by_position(columns, "string").alias("feature"), ratio.alias("score"))


def equal_width_bin(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0 … bins-1 between ``low`` and ``high``; the last bin is closed, a constant column is bin 0."""
    at = F.floor(F.try_divide(c - low, high - low) * F.lit(bins)).cast("int")
    return F.when(c.isNotNull(), F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)))


def mutual_info(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    bins: int = 20,
    method: str = "width",
    error: float = 0.001,
) -> DataFrame:
    """Mutual information (nats) between each binned feature and the label; nulls count as the mean.

    ``method`` is ``width`` for equal-width bins or ``quantile`` for bins of about equal size. Their cuts are sketched
    within ``error`` of the wanted ranks; 0 takes the exact, interpolated quantiles.
    """
    cells = _long(df, columns, label)
    if method == "width":
        # The mean lies inside the range, so filling does not move the ends.
        ranges = value_ranges(df.where(F.col(label).isNotNull()), columns)
        low, high = (_by_position([ranges[c][end] for c in columns]) for end in (0, 1))
        chosen = equal_width_bin(F.col("value"), low, high, bins)
    elif method == "quantile":
        # Cuts of the same cells that are scored; a feature without values is one bin.
        rows = df.where(F.col(label).isNotNull())
        means = column_means(rows, columns)
        known = [c for c in columns if means[c] is not None]
        filled = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) for c in known])
        shares = [i / bins for i in range(1, bins)]
        if error > 0:
            cuts = dict(zip(known, filled.approxQuantile(known, shares, error) if known else []))
        else:
            cuts = {r["column_name"]: r["quantiles"] for r in exact_quantiles(filled, known, shares).collect()}
        chosen = F.lit(0)
        for i in range(bins - 1):
            ends = _by_position([cuts[c][i] if cuts.get(c) else None for c in columns])
            chosen = chosen + F.coalesce((F.col("value") > ends).cast("int"), F.lit(0))
    else:
        raise ValueError(f"method must be 'width' or 'quantile', not {method!r}")
    joint = cells.groupBy("at", chosen.alias("bin"), "class").agg(F.count("*").alias("n"))

    # From here on one row per feature, bin and class.
    def size(*keys: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*keys))

    both, every = F.col("n"), size("at")
    term = both / every * F.log(both * every / (size("at", "bin") * size("at", "class")))
    scores = joint.withColumn("term", term).groupBy("at").agg(F.sum("term").alias("score"))
    return scores.select(_by_position(columns, "string").alias("feature"), "score")


def select_top(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` best features; equal scores in order of name."""
    return scores.orderBy(F.desc("score"), "feature").limit(n)


def apply_selection(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Only the named features, and the columns to ``keep`` such as key and label."""
    return df.select(*keep, *names)


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Feature vector for a learner; missing values must be filled before."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)
