"""Feature tables, submissions, id lists and cluster models as files."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repurchase.functions import expressions as X
from repurchase.schema import SUBMISSION_SCHEMA


def save_features(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), measure: bool = False) -> None:
    """Store a feature table; with ``measure`` its statistics are taken while it is written, and stored beside it."""
    if not measure:
        df.write.mode("error").partitionBy(*partition_by).parquet(path)
        return
    seen = Observation()
    df.observe(seen, *[m.alias(name) for name, m in _measures(df).items()]).write.mode("error").partitionBy(*partition_by).parquet(path)
    spark, taken = df.sparkSession, seen.get
    kinds = T.StructType([T.StructField("files", T.StringType()), *_measured_fields(df)])
    row = tuple([_files(spark, path)] + [taken[f.name] for f in kinds.fields[1:]])
    spark.createDataFrame([row], kinds).coalesce(1).write.parquet(f"{path}/{_STATISTICS}")


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# A folder that readers of the table pass over.
_STATISTICS = "_statistics"


def _measures(df: DataFrame) -> dict[str, Column]:
    """Aggregates of every numeric or time column: values, sum, least, greatest, distance from whole numbers, non-finite."""
    out = {"rows": F.count(F.lit(1))}
    for f in df.schema.fields:
        out[f"{f.name}:values"] = F.count(f.name)
        if isinstance(f.dataType, T.NumericType):
            value = F.col(f.name).cast("double")
            finite = F.when(~X.non_finite(value), value)
            out[f"{f.name}:sum"] = F.sum(value)
            out[f"{f.name}:off"] = F.coalesce(F.sum(F.coalesce(F.abs(finite - finite.try_cast("long")), F.lit(0.0))), F.lit(0.0))
            out[f"{f.name}:finite"] = F.count(finite)
            out[f"{f.name}:finite_min"], out[f"{f.name}:finite_max"] = F.min(finite), F.max(finite)
        if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f"{f.name}:min"], out[f"{f.name}:max"] = F.min(f.name), F.max(f.name)
    return out


def _measured_fields(df: DataFrame) -> list[T.StructField]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fixed = {"rows": T.LongType(), "values": T.LongType(), "finite": T.LongType()}
    fixed |= dict.fromkeys(("sum", "off", "finite_min", "finite_max"), T.DoubleType())
    out = []
    for name in _measures(df):
        column, _, part = name.rpartition(":")
        out.append(T.StructField(name, fixed[part] if part in fixed else kinds[column]))
    return out


def _files(spark: SparkSession, path: str) -> str:
    """A fingerprint of the table's files; Spark gives every file it writes a name of its own."""
    names = sorted(f.rpartition("/")[2] for f in spark.read.parquet(path).inputFiles())
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


@dataclass(frozen=True)
class Statistics:
    """What was measured while a table was written."""

    found: dict[str, Any]

    @property
    def rows(self) -> int:
        return self.found["rows"]

    @property
    def columns(self) -> list[str]:
        return [name.removesuffix(":values") for name in self.found if name.endswith(":values")]

    def of(self, column: str, part: str) -> Any:
        return self.found[f"{column}:{part}"]

    def mean(self, column: str) -> float | None:
        values = self.of(column, "values")
        return self.of(column, "sum") / values if values else None

    def span(self, column: str) -> tuple[Any, Any]:
        return self.of(column, "min"), self.of(column, "max")

    def nulls(self, column: str) -> int:
        return self.rows - self.of(column, "values")


def load_statistics(spark: SparkSession, path: str) -> Statistics | None:
    """The statistics stored with a table; None if there are none, or if its files have changed since."""
    try:
        row = spark.read.parquet(f"{path}/{_STATISTICS}").first()
    except AnalysisException:
        return None
    if row is None or row["files"] != _files(spark, path):
        return None
    return Statistics({name: v for name, v in row.asDict().items() if name != "files"})


# --- tables dealt into buckets by customer -----------------------------------------------------


def save_buckets(df: DataFrame, name: str, path: str, buckets: int, key: str = "customer_id") -> DataFrame:
    """Store a table in buckets of its key, sorted in each, and register it as ``name``.

    Tables with the same number of buckets join, and aggregate by the key, without moving a row. The rows are dealt out
    once here, so a bucket is one file; ``buckets`` should make a bucket as large as a task may read.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("error").bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_buckets(spark: SparkSession, name: str, path: str, buckets: int, key: str = "customer_id") -> DataFrame:
    """Register what :func:`save_buckets` stored in another session under ``name``."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(
        f"create table `{name}` ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets"
        f" location '{path}'"
    )
    return spark.table(name)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """The customers to be judged, with a result column to be replaced."""
    return spark.read.schema(SUBMISSION_SCHEMA).option("header", True).csv(path)


def write_submission(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV parts with header, in customer order across the parts; or one file, sorted by a single task.

    One file is for hand-in: a line is two short numbers, so tens of millions of customers fit a task.
    """
    rows = df.select("customer_id", "result")
    ordered = rows.coalesce(1).sortWithinPartitions("customer_id") if single_file else rows.orderBy("customer_id")
    ordered.write.mode("error").option("header", True).csv(path)


def write_ids(df: DataFrame, path: str, key: str = "customer_id") -> None:
    """One id per line, no header."""
    df.select(key).write.mode("error").option("header", False).csv(path)


def read_ids(spark: SparkSession, path: str, key: str = "customer_id") -> DataFrame:
    return spark.read.schema(f"{key} long").option("header", False).csv(path)


def save_centroids(centroids: DataFrame, labels: DataFrame, path: str) -> None:
    """A cluster model: centroids (cluster, center) with the label of each cluster."""
    model = centroids.join(labels, "cluster", "left")
    model.select("cluster", "center", "label").write.mode("error").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    model = spark.read.parquet(path)
    return model.select("cluster", "center"), model.select("cluster", F.col("label"))
