"""Cutoffs in time, purchase labels, and stacking or splitting labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repurchase.functions import expressions as X
from repurchase.schema import MONTH_COLUMN


def _in_time(tx: DataFrame, bound: Column, time: str, inside: Column, months) -> DataFrame:
    """Lines inside a bound in time; on a table stored by month, only from the months it touches."""
    if time == "order_pay_time" and MONTH_COLUMN in tx.columns:
        inside = inside & months(F.col(MONTH_COLUMN), X.month_number(bound))
    return tx.where(inside)


def history(tx: DataFrame, until, time: str = "order_pay_time") -> DataFrame:
    """Lines up to and including the cutoff."""
    cutoff = X.as_timestamp(until)
    return _in_time(tx, cutoff, time, F.col(time) <= cutoff, Column.__le__)


def future(tx: DataFrame, until, time: str = "order_pay_time") -> DataFrame:
    """Lines strictly after the cutoff."""
    cutoff = X.as_timestamp(until)
    return _in_time(tx, cutoff, time, F.col(time) > cutoff, Column.__ge__)


def since(tx: DataFrame, start, day: str = "order_pay_time") -> DataFrame:
    """Lines on days strictly after ``start``.

    Written as a bound on the timestamp itself, which a Parquet scan can use to skip data.
    """
    first = F.date_add(X.as_date(start), 1).cast("timestamp_ntz")
    return _in_time(tx, first, day, F.col(day) >= first, Column.__ge__)


def buyers(tx: DataFrame, key: str = "customer_id") -> DataFrame:
    """The different customers of ``tx``."""
    return tx.where(F.col(key).isNotNull()).select(key).distinct()


def with_membership(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Flag (1/0) whether ``key`` occurs among the distinct keys of ``members``."""
    flagged = members.select(key, F.lit(1).alias(name))
    return df.join(flagged, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def label_future(tx: DataFrame, until, key: str = "customer_id", time: str = "order_pay_time") -> DataFrame:
    """1 for customers with history who have any line after the cutoff, else 0; one scan, one shuffle."""
    cutoff = X.as_timestamp(until)
    seen = F.max(F.when(F.col(time) <= cutoff, 1))
    returns = F.max(F.when(F.col(time) > cutoff, 1).otherwise(0))
    labelled = tx.where(F.col(key).isNotNull()).groupBy(key).agg(seen.alias("_seen"), returns.alias("label"))
    return labelled.where(F.col("_seen") == 1).drop("_seen")


def horizon_label(value: Column, day: Column, until, days: int) -> Column:
    """Aggregate: 1 if the largest daily value in the ``days`` days from ``until`` on is positive."""
    ahead = F.datediff(day, X.day_of(until))
    largest = F.max(F.when(ahead.between(0, days - 1), value))
    return (F.coalesce(largest, F.lit(0.0)) > 0).cast("int")


def label_horizon(daily: DataFrame, until, days: int = 30, key: str = "customer_id") -> DataFrame:
    """Fixed-horizon label of every customer in the daily table."""
    return daily.groupBy(key).agg(horizon_label(F.col("day_num"), F.col("day"), until, days).alias("label"))


def stack(train: DataFrame, score: DataFrame) -> DataFrame:
    """Both tables below each other; columns found in only one of them become null."""
    return train.unionByName(score, allowMissingColumns=True)


def split_by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows with a label, rows without."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())
