"""Where intermediate results go so that they outlive a lost executor, and joins in which nulls meet."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which the cluster names in ``spark.checkpoint.dir``.

    Only a session whose tasks run in this very process may go without: it gets a temporary folder. Any
    other one, a cluster of processes on this machine included, is refused.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if configured is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
            configured = tempfile.mkdtemp(prefix="repurchase-")
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return configured or current


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def join_null_safe(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key meets a null key; the keys of ``df`` are kept."""
    other = lookup.withColumnsRenamed({c: f"_key_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in on])
    return df.join(other, same, how).drop(*[f"_key_{c}" for c in on])
