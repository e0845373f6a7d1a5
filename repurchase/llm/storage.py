"""Shared intermediate tables, and positions in an order without a single sorting task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words are separated by these characters only.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in a single-process session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        named = "file://" + tempfile.mkdtemp(prefix="repurchase-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


# Paths of this process's intermediate tables, until they are released.
_SCRATCH: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that ``release`` removes."""
    _SCRATCH.append(fresh(spark, name))
    return _SCRATCH[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, in whatever store it is."""
    if not path.startswith(work_dir(spark) + "/"):
        raise ValueError(f"{path} is not an intermediate table")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables made so far; DataFrames that still depend on them can no longer be read."""
    while _SCRATCH:
        remove(spark, _SCRATCH.pop())


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and no longer dependent on its inputs."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds; missing ones are an error."""
    return df.select(*names)


def spread(*keys: str | Column, buckets: int) -> Column:
    """A bucket that depends on the given columns alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def with_start(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same keys that come earlier.

    The order is by ``bucket`` first and ``order`` within. Each task sorts one bucket of one key, and the
    offsets of the buckets come from their sums, so a key with most of the rows is spread over all its
    buckets. ``df`` is read twice and must give the same rows both times.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )
