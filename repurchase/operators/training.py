"""Gradient-boosted trees on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.operators.clean import clean_inf
from repurchase.operators.selection import assemble
from repurchase.runtime import join_null_safe, shared_dir
from repurchase.schema import GbtParams


def learnable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features as double with null, NaN and infinities as 0, since the trees take no missing values."""
    return clean_inf(df.withColumns({c: F.col(c).cast("double") for c in columns}), columns, 0.0)


def with_null_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_missing`` (1/0), so that filling does not lose what was missing."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add weights under which every class counts the same in total; rows without label are a class of their own."""
    # One row per class, sent to the rows: dealt out by class, all rows of one would meet in a task.
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    rows = sizes.agg(F.sum("_n") / F.count("*")).scalar()
    weights = sizes.select(label, (rows / F.col("_n")).alias(name))
    return join_null_safe(df, F.broadcast(weights), [label])


def train_gbt(
    df: DataFrame, columns: Sequence[str], label: str, params: GbtParams, weight: str | None = None
) -> GBTClassificationModel:
    shared_dir(df.sparkSession)
    learner = GBTClassifier(
        featuresCol="features",
        labelCol=label,
        lossType="logistic",
        maxIter=params.max_iter,
        stepSize=params.step_size,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_instances,
        subsamplingRate=params.subsampling_rate,
        maxBins=params.max_bins,
        seed=params.seed,
        checkpointInterval=params.checkpoint_interval,
        cacheNodeIds=True,
        **({"weightCol": weight} if weight else {}),
        **params.extra,
    )
    kept = [label, *([weight] if weight else [])]
    rows = assemble(learnable(df.select(*kept, *columns), columns), columns).select(*kept, "features")
    return learner.fit(rows)


def score(model: GBTClassificationModel, df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with the probability of class 1 and the class the learner itself decides for."""
    rows = assemble(learnable(df, columns), columns)
    return model.transform(rows).select(
        *keep,
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def fit_evaluate(
    train: DataFrame, holdout: DataFrame, columns: Sequence[str], key: str, label: str, params: GbtParams
) -> DataFrame:
    """Fit on ``train``; key, label, score and prediction of the holdout."""
    return score(train_gbt(train, columns, label, params), holdout, columns, [key, label])


def fit_predict(
    labelled: DataFrame, unlabelled: DataFrame, columns: Sequence[str], key: str, label: str, params: GbtParams
) -> DataFrame:
    """Fit on all labelled rows; key, score and prediction of the unlabelled ones."""
    return score(train_gbt(labelled, columns, label, params), unlabelled, columns, [key])
