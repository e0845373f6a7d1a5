"""Reproducible train and holdout splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repurchase.operators.ranking import ranked_values
from repurchase.runtime import join_null_safe

# Hexadecimal digits of the hash that name a slice: 65,536 of them.
SLICE_DIGITS = 4


def shuffle_key(key: str, seed: int) -> Column:
    """Hash that orders rows the same way in every run and engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def with_holdout(
    df: DataFrame, label: str, share: float, seed: int, key: str, exact: bool = True, name: str = "holdout"
) -> DataFrame:
    """Flag a random ``share`` of each class; ``key`` must be unique. Rows without label are a class like any other.

    The exact form takes precisely round(share · n) rows of every class, however large a class is: counts per
    slice of the hash tell in which slice the last row taken of a class lies, only that slice is ranked, and the rows
    themselves are flagged where they are, all in one lazy plan. The other form compares the hash with a bound, and is
    only close to the share.
    """
    hashed = df.withColumn("_hash", shuffle_key(key, seed))
    if not exact:
        # The first 13 hexadecimal digits as a number in [0, 1).
        drawn = F.conv(F.substring("_hash", 1, 13), 16, 10).cast("double") / float(16**13)
        return hashed.withColumn(name, drawn < share).drop("_hash")
    # The first digits of the hash name a slice of equal expected size, the same in every pass.
    thin = hashed.select(label, "_hash", key, F.conv(F.substring("_hash", 1, SLICE_DIGITS), 16, 10).cast("int").alias("_slice"))
    counted = thin.groupBy(label, "_slice").agg(F.count("*").alias("_n"))
    # At most one row per slice and class.
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_slice"))
    size = F.sum("_n").over(Window.partitionBy(label))
    wanted = F.floor(F.col("_size") * F.lit(share) + 0.5)
    counted = counted.select(label, "_slice", "_n", upto.alias("_upto"), size.alias("_size"))
    # The slice in which the last row taken of a class lies, and how many are taken of it.
    border = counted.where((wanted > F.col("_upto") - F.col("_n")) & (wanted <= F.col("_upto")))
    border = border.select(label, "_slice", (wanted - (F.col("_upto") - F.col("_n"))).alias("_left"))
    inside = join_null_safe(thin, F.broadcast(border), [label, "_slice"])
    place = F.row_number().over(Window.partitionBy(label).orderBy("_hash", key))
    cuts = inside.withColumn("_at", place).where("_at = _left")
    cuts = cuts.select(label, F.col("_hash").alias("_cut_hash"), F.col(key).alias("_cut_key"))
    taken = (F.col("_hash") < F.col("_cut_hash")) | (
        (F.col("_hash") == F.col("_cut_hash")) & (F.col(key) <= F.col("_cut_key"))
    )
    # A class of which nothing is taken has no cut. Dealt out by class for the join, all rows of one would meet in a task.
    flagged = join_null_safe(hashed, F.broadcast(cuts), [label], "left").withColumn(name, F.coalesce(taken, F.lit(False)))
    return flagged.drop("_hash", "_cut_hash", "_cut_key")


def stratified_split(
    df: DataFrame, label: str, share: float, seed: int, key: str, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(train, holdout) with ``share`` of each class held out."""
    flagged = with_holdout(df, label, share, seed, key, exact, "_holdout")
    return flagged.where(~F.col("_holdout")).drop("_holdout"), flagged.where("_holdout").drop("_holdout")


def ordered_split(df: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(first ``share`` of the rows in order of the unique ``key``, the rest); a row without key comes first.

    Brackets find the last key of the first part; the rows are filtered by it where they are.
    """
    keys = df.select(key).persist()
    try:
        rows, keyed = keys.agg(F.count("*"), F.count(key)).first()
        taken = math.floor(rows * share)
        # Of the rows with a key, those that are left after the ones without.
        last = taken - (rows - keyed)
        early = F.lit(taken > 0) & F.col(key).isNull()
        if last > 0:
            cut = ranked_values(keys, {key: [last - 1]}, {key: keyed})[key][last - 1]
            early = early | F.coalesce(F.col(key) <= F.lit(cut), F.lit(False))
    finally:
        keys.unpersist()
    return df.where(early), df.where(~early)
