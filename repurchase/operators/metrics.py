"""Metrics of labels against decisions or scores; each returns one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repurchase.operators.ranking import number_slice, sliced_totals
from repurchase.operators.scaling import value_ranges
from repurchase.operators.selection import equal_width_bin


def _right(label: str, decision: str) -> Column:
    return F.coalesce(F.col(label) == F.col(decision), F.lit(False)).cast("double")


def balanced_accuracy(df: DataFrame, label: str, decision: str) -> DataFrame:
    """Mean over the classes of the label of the share decided correctly.

    A row without decision counts as wrong; rows without label are not judged.
    """
    right = F.avg(_right(label, decision))
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(right.alias("recall"))
    return per_class.agg(F.avg("recall").alias("balanced_accuracy"))


def accuracy(df: DataFrame, label: str, decision: str) -> DataFrame:
    """Share decided correctly; missing decisions and labels as in :func:`balanced_accuracy`."""
    return df.where(F.col(label).isNotNull()).agg(F.avg(_right(label, decision)).alias("accuracy"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve; pairs with equal scores count half.

    Rows are merged per score first; the score itself names the slice in which its running total is taken. Twice the
    area is added up in whole numbers.
    """
    counted = df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("ones"), F.count(F.when(F.col(label) == 0, 1)).alias("zeros")
    )
    ranked = sliced_totals(counted, {"upto": F.col("zeros")}, [F.col("score")], number_slice(F.col("score")))
    ones, zeros, upto = (F.col(c).cast("decimal(18,0)") for c in ("ones", "zeros", "upto"))
    twice = F.sum(ones * (upto + upto - zeros))
    pairs = F.sum("ones").cast("double") * F.sum("zeros").cast("double")
    return ranked.agg(F.try_divide(twice.cast("double"), pairs * 2.0).alias("auc"))


def log_loss(df: DataFrame, label: str, score: str, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1.0 - eps))
    y = F.col(label).cast("double")
    return df.agg((-F.avg(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))).alias("log_loss"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum, empty bins included.

    A column without values gets empty bins between 0 and 1.
    """
    low, high = value_ranges(df, [column])[column]
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        # A constant column gets a range of width 1 around its value.
        low, high = low - 0.5, high + 0.5
    low, high = F.lit(low).cast("double"), F.lit(high).cast("double")
    width = (high - low) / F.lit(bins)
    value, at = F.col(column), F.col("_at")
    # Rounding can put a value next to an edge into the neighbouring bin; the edges decide.
    settled = (
        F.when((at > 0) & (value < low + at * width), at - 1)
        .when((at < bins - 1) & (value >= low + (at + 1) * width), at + 1)
        .otherwise(at)
    )
    placed = df.where(value.isNotNull()).withColumn("_at", equal_width_bin(value, low, high, bins))
    placed = placed.select(settled.alias("bin"))
    counted = placed.groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("low"),
        (low + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )
