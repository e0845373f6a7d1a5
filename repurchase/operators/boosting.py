"""Boosted trees with penalised leaves and margins kept as a table, so that long fits can be resumed.

Each round fits one of Spark's regression trees to the Newton step of the logistic loss. One aggregation per round then
gives every leaf the value -soft(G, l1) / (H + l2) from the sums of its gradients and hessians, and a row's margin grows by
the value of its leaf. Margins and model are written every few rounds: that cuts the lineage, and a fit that is started
again on the same folder goes on from the last one.

A model is plain data: the margin of the mean and, per tree, its splits and leaf values. Leaves are found by column
expressions, so scoring needs no learner.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repurchase.operators.selection import assemble
from repurchase.operators.training import learnable
from repurchase.runtime import scratch_path
from repurchase.schema import BoostParams

_MARGIN, _LEAF = "_margin", "_leaf"
# A leaf is its number; a split is (feature, threshold, where <=, where >).
Tree = int | tuple[int, float, "Tree", "Tree"]


@dataclass(frozen=True)
class BoostedModel:
    columns: tuple[str, ...]
    base: float
    trees: tuple[Tree, ...] = ()
    values: tuple[tuple[float, ...], ...] = ()

    def dumps(self) -> str:
        return json.dumps([self.columns, self.base, self.trees, self.values])

    @staticmethod
    def loads(text: str) -> BoostedModel:
        columns, base, trees, values = json.loads(text)
        return BoostedModel(tuple(columns), base, tuple(map(_frozen, trees)), tuple(map(tuple, values)))


def _frozen(node: int | list) -> Tree:
    return node if isinstance(node, int) else (node[0], node[1], _frozen(node[2]), _frozen(node[3]))


def parse_tree(described: str) -> Tree:
    """The splits of a fitted tree, from the learner's own description of it."""
    lines = iter([line.strip() for line in described.splitlines()[1:] if line.strip()])
    leaves = 0

    def node() -> Tree:
        nonlocal leaves
        line = next(lines)
        if line.startswith("Predict"):
            leaves += 1
            return leaves - 1
        # If (feature 3 <= 0.5) … Else (feature 3 > 0.5)
        feature, threshold = line.split("(feature ")[1].rstrip(")").split(" <= ")
        below = node()
        next(lines)
        return int(feature), float(threshold), below, node()

    return node()


def leaf_of(tree: Tree, columns: Sequence[str]) -> Column:
    """The number of the leaf a row falls into."""
    if isinstance(tree, int):
        return F.lit(tree)
    feature, threshold, below, above = tree
    return F.when(F.col(columns[feature]) <= threshold, leaf_of(below, columns)).otherwise(leaf_of(above, columns))


def _value(leaf: Column, values: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), leaf)


def _leaf_values(rows: DataFrame, leaves: int, label: str, params: BoostParams) -> list[float]:
    """Penalised Newton steps: one aggregation, one row per leaf."""
    p = F.lit(1.0) / (F.exp(-F.col(_MARGIN)) + 1.0)
    sums = rows.groupBy(_LEAF).agg(F.sum(p - F.col(label)).alias("g"), F.sum(p * (1.0 - p)).alias("h")).collect()
    values = [0.0] * leaves
    for r in sums:
        soft = math.copysign(max(abs(r["g"]) - params.l1, 0.0), r["g"])
        values[r[_LEAF]] = -params.step_size * soft / (r["h"] + params.l2)
    return values


def train_boosted(df: DataFrame, columns: Sequence[str], label: str, params: BoostParams, folder: str | None = None) -> BoostedModel:
    """Fit on the rows with a label (0 or 1); null, NaN and infinite features count as 0.

    ``folder``, below the shared one if not given, holds margins and model of every ``store_every``-th round. A fit of
    the same table and settings that finds them there goes on after the last.
    """
    spark, columns = df.sparkSession, tuple(columns)
    folder = folder or scratch_path(spark, "boosting")
    model, rows = _resume(spark, folder)
    if rows is None:
        kept = learnable(df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias(label), *columns), columns)
        mean = kept.agg(F.avg(label)).first()[0]
        if mean is None or mean in (0.0, 1.0):
            # One class, or no rows: nothing to learn from.
            return BoostedModel(columns, 0.0 if mean is None else math.copysign(30.0, mean - 0.5))
        model = BoostedModel(columns, math.log(mean / (1 - mean)))
        rows = assemble(kept, columns).withColumn(_MARGIN, F.lit(model.base))
        rows = _store(rows, model, folder)
    cached: list[DataFrame] = []
    for turn in range(len(model.trees), params.max_iter):
        p = F.lit(1.0) / (F.exp(-F.col(_MARGIN)) + 1.0)
        h = F.greatest(p * (1.0 - p), F.lit(1e-6))
        learner = DecisionTreeRegressor(
            featuresCol="features", labelCol="_step", weightCol="_h", maxDepth=params.max_depth, maxBins=params.max_bins,
            minInstancesPerNode=params.min_instances, seed=params.seed + turn,
        )
        fitted = learner.fit(rows.select("features", ((F.col(label) - p) / h).alias("_step"), h.alias("_h")))
        tree = parse_tree(fitted.toDebugString)
        values = _leaf_values(rows.withColumn(_LEAF, leaf_of(tree, columns)), (fitted.numNodes + 1) // 2, label, params)
        model = BoostedModel(columns, model.base, (*model.trees, tree), (*model.values, tuple(values)))
        rows = rows.withColumn(_MARGIN, F.col(_MARGIN) + _value(leaf_of(tree, columns), values))
        if (turn + 1) % params.store_every == 0 or turn + 1 == params.max_iter:
            rows = _store(rows, model, folder)
            while cached:
                cached.pop().unpersist()
        else:
            cached.append(rows.persist())
    return model


def _store(rows: DataFrame, model: BoostedModel, folder: str) -> DataFrame:
    """Write margins, then the model: where the model is, the margins are complete."""
    spark, place = rows.sparkSession, f"{folder}/after-{len(model.trees):06d}"
    rows.write.mode("overwrite").parquet(f"{place}/rows")
    spark.createDataFrame([(model.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/model")
    return spark.read.parquet(f"{place}/rows")


def _resume(spark: SparkSession, folder: str) -> tuple[BoostedModel | None, DataFrame | None]:
    files = spark.read.option("ignoreMissingFiles", True).option("recursiveFileLookup", False)
    try:
        found = files.text(f"{folder}/after-*/model").select("value", F.col("_metadata.file_path").alias("file")).orderBy(F.desc("file")).first()
    except Exception as error:  # no such folder yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None, None
    if found is None:
        return None, None
    model = BoostedModel.loads(found["value"])
    return model, spark.read.parquet(f"{folder}/after-{len(model.trees):06d}/rows")


def score_boosted(model: BoostedModel, df: DataFrame, keep: Sequence[str], trees_at_once: int = 50) -> DataFrame:
    """``keep`` columns, score (probability of class 1) and prediction; trees are added up some at a time."""
    columns = list(model.columns)
    rows = learnable(df.select(*dict.fromkeys([*keep, *columns])), columns).withColumn(_MARGIN, F.lit(model.base))
    for at in range(0, len(model.trees), trees_at_once):
        for tree, values in list(zip(model.trees, model.values))[at : at + trees_at_once]:
            rows = rows.withColumn(_MARGIN, F.col(_MARGIN) + _value(leaf_of(tree, columns), values))
        if at + trees_at_once < len(model.trees):
            path = scratch_path(df.sparkSession, "margins")
            rows.write.parquet(path)
            rows = df.sparkSession.read.parquet(path)
    p = F.lit(1.0) / (F.exp(-F.col(_MARGIN)) + 1.0)
    return rows.select(*keep, p.alias("score"), (p > 0.5).cast("int").alias("prediction"))
