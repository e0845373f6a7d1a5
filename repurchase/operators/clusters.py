"""K-means clusters used as a classifier: each cluster stands for its most frequent label.

A model is two tables of k rows: centroids (cluster, center) and labels (cluster, label). Points are an
array column. Every iteration is one Spark job that combines its sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repurchase.operators.splits import shuffle_key

UNKNOWN = -1


def as_point(columns: Sequence[str]) -> Column:
    """Array of doubles from feature columns."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def init_centroids(df: DataFrame, k: int, seed: int, key: str, features: str = "features") -> DataFrame:
    """``k`` different rows drawn by hash."""
    drawn = df.select(key, F.col(features).cast("array<double>").alias("center"), shuffle_key(key, seed).alias("_hash"))
    chosen = drawn.orderBy("_hash", key).limit(k)
    # Numbering k rows.
    cluster = F.row_number().over(Window.orderBy("_hash", key)) - 1
    return chosen.select(cluster.alias("cluster"), "center")


def _centers(centroids: DataFrame) -> np.ndarray:
    """The k centers as a matrix, row i for cluster i; k is chosen by the caller."""
    rows = centroids.orderBy("cluster").collect()
    if [r["cluster"] for r in rows] != list(range(len(rows))):
        raise ValueError("clusters must be numbered 0 … k-1")
    return np.array([r["center"] for r in rows], dtype=np.float64)


def _table(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def _matrix(points: pa.Array, width: int) -> np.ndarray:
    values = points.flatten()
    if points.null_count or values.null_count or len(values) != len(points) * width:
        raise ValueError(f"points must be arrays of {width} numbers")
    return values.to_numpy(zero_copy_only=False).reshape(len(points), width)


def _two_nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest center, the first one on a tie, and the squared distances to it and to the next one."""
    best = np.zeros(len(x), dtype=np.int32)
    least, second = np.full(len(x), np.inf), np.full(len(x), np.inf)
    for i, center in enumerate(centers):
        off = x - center
        squared = np.einsum("ij,ij->i", off, off)
        closer = squared < least
        second = np.where(closer, least, np.minimum(second, squared))
        best[closer], least[closer] = i, squared[closer]
    return best, least, second


def _nearest(centers: np.ndarray):
    """Index of the nearest center for one Arrow batch of points at a time."""

    @F.arrow_udf("int")
    def nearest(points: pa.Array) -> pa.Array:
        return pa.array(_two_nearest(_matrix(points, centers.shape[1]), centers)[0], pa.int32())

    return nearest


_BOUNDED = "struct<cluster:int,upper:double,lower:double>"
# From so many centers on, distances that bounds can spare cost more than keeping the bounds.
BOUNDED_FROM = 100


def _bounded(best: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(best, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64())], ["cluster", "upper", "lower"]
    )


def _first_bounds(centers: np.ndarray):
    """Nearest center, the distance to it, and a lower bound of the distance to any other."""

    @F.arrow_udf(_BOUNDED)
    def measured(points: pa.Array) -> pa.Array:
        best, least, second = _two_nearest(_matrix(points, centers.shape[1]), centers)
        return _bounded(best, np.sqrt(least), np.sqrt(second))

    return measured


def _next_bounds(centers: np.ndarray, moved: np.ndarray):
    """The same after every center moved by the given distance; distances are computed only where bounds overlap."""
    k = len(centers)
    # The furthest any other center has moved, and half the distance to the nearest other center.
    order = np.argsort(-moved, kind="stable")
    others = np.full(k, moved[order[0]])
    others[order[0]] = moved[order[1]] if k > 1 else 0.0
    half = np.empty(k)
    for i in range(k):
        apart = np.sqrt(((centers - centers[i]) ** 2).sum(axis=1))
        half[i] = np.delete(apart, i).min(initial=np.inf) / 2

    @F.arrow_udf(_BOUNDED)
    def narrowed(points: pa.Array, state: pa.Array) -> pa.Array:
        best, upper, lower = (state.field(i).to_numpy(zero_copy_only=False).copy() for i in range(3))
        upper, lower = upper + moved[best], lower - others[best]
        # Rounding must not settle what is nearly a tie.
        open_ = np.flatnonzero(~(upper * (1 + 1e-9) + 1e-12 < np.maximum(lower, half[best])))
        if len(open_):
            x = _matrix(points, centers.shape[1])[open_]
            nearest, least, second = _two_nearest(x, centers)
            best[open_], upper[open_], lower[open_] = nearest, np.sqrt(least), np.sqrt(second)
        return _bounded(best, upper, lower)

    return narrowed


def _assign(df: DataFrame, centers: np.ndarray, features: str) -> DataFrame:
    return df.withColumn("cluster", _nearest(centers)(F.col(features).cast("array<double>")))


def assign(df: DataFrame, centroids: DataFrame, features: str = "features") -> DataFrame:
    """Add the ``cluster`` whose center is nearest."""
    return _assign(df, _centers(centroids), features)


def _means(assigned: DataFrame, features: str) -> DataFrame:
    mean = Summarizer.mean(array_to_vector(F.col(features).cast("array<double>")))
    return assigned.groupBy("cluster").agg(vector_to_array(mean).alias("mean"))


def update(assigned: DataFrame, centroids: DataFrame, features: str = "features") -> DataFrame:
    """Centroids moved to the mean of their members; one without members stays."""
    moved = centroids.join(_means(assigned, features), "cluster", "left")
    return moved.select("cluster", F.coalesce("mean", "center").alias("center"))


def kmeans_fit(
    df: DataFrame,
    k: int = 10,
    max_iter: int = 30,
    tol: float = 1e-4,
    seed: int = 42,
    key: str = "customer_id",
    features: str = "features",
) -> DataFrame:
    """Centroids after at most ``max_iter`` rounds, fewer once all centers together move less than ``tol``.

    Only the k centers reach the driver. The points are kept on the executors between rounds and are
    recomputed where an executor is lost. With many centers each point keeps bounds of its distances, by which most
    distances of later rounds need not be computed; the centers are the same either way.
    """
    points = df.select(key, F.col(features).cast("array<double>").alias(features)).persist()
    kept, moved, state = [points], None, points
    try:
        centers = _centers(init_centroids(points, k, seed, key, features))
        for _ in range(max_iter):
            if len(centers) < BOUNDED_FROM:
                state = _assign(points, centers, features)
            else:
                known = _first_bounds(centers)(features) if moved is None else _next_bounds(centers, moved)(F.col(features), F.col("state"))
                state = state.select(key, features, known.alias("state")).withColumn("cluster", F.col("state.cluster")).persist()
                kept.append(state)
            after = centers.copy()
            for row in _means(state, features).collect():
                after[row["cluster"]] = row["mean"]
            # The round before is no longer read.
            while len(kept) > 2:
                kept.pop(1).unpersist()
            if np.linalg.norm(after - centers) < tol:
                break
            moved, centers = np.sqrt(((after - centers) ** 2).sum(axis=1)), after
    finally:
        for df_ in kept:
            df_.unpersist()
    return _table(df.sparkSession, centers)


def cluster_labels(assigned: DataFrame, centroids: DataFrame, label: str = "label") -> DataFrame:
    """Most frequent label of each cluster, the smallest one on a tie, -1 without members."""
    counted = assigned.groupBy("cluster", F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    frequent = counted.groupBy("cluster").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    joined = centroids.select("cluster").join(frequent, "cluster", "left")
    return joined.select("cluster", F.coalesce("label", F.lit(UNKNOWN)).alias("label"))


def kmeans_predict(
    df: DataFrame, centroids: DataFrame, labels: DataFrame, features: str = "features", name: str = "prediction"
) -> DataFrame:
    """Add the label of the nearest cluster, -1 where it has none."""
    # One row per cluster.
    named = labels.select("cluster", F.col("label").alias(name))
    joined = assign(df, centroids, features).join(named, "cluster", "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(UNKNOWN))).drop("cluster")


def stack_points(
    df: DataFrame, centroids: DataFrame, key: str = "customer_id", features: str = "features"
) -> DataFrame:
    """Rows and centroids in one table (kind, id, point)."""
    rows = df.select(
        F.lit("row").alias("kind"), F.col(key).cast("long").alias("id"),
        F.col(features).cast("array<double>").alias("point"),
    )
    centers = centroids.select(
        F.lit("centroid").alias("kind"), F.col("cluster").cast("long").alias("id"), F.col("center").alias("point")
    )
    return rows.unionByName(centers)


def pca_project(
    df: DataFrame, centroids: DataFrame, n: int = 30, key: str = "customer_id", features: str = "features"
) -> tuple[DataFrame, list[float]]:
    """Rows and centroids on their first ``n`` principal components, and the share of variance of each."""
    stacked = stack_points(df, centroids, key, features).withColumn("_vector", array_to_vector("point"))
    centre = StandardScaler(inputCol="_vector", outputCol="_centred", withMean=True, withStd=False)
    centred = centre.fit(stacked).transform(stacked)
    model = PCA(k=n, inputCol="_centred", outputCol="_projected").fit(centred)
    projected = model.transform(centred).select("kind", "id", vector_to_array("_projected").alias("components"))
    return projected, [float(v) for v in model.explainedVariance]
