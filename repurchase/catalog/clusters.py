"""K-means on the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import table
from repurchase.catalog.registry import query
from repurchase.operators import clusters as K
from repurchase.functions.expressions import distance
from repurchase.plans.forecast import cluster_holdout
from repurchase.runtime import scratch_path
from repurchase.sources import storage

CLUSTERS, ROUNDS, TOLERANCE, SEED = 10, 30, 1e-4, 42


def points(spark, sf_dir) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def start(df: DataFrame) -> DataFrame:
    return K.init_centroids(df, CLUSTERS, SEED, "vec_id")


def fitted(spark, sf_dir) -> DataFrame:
    return K.kmeans_fit(points(spark, sf_dir), CLUSTERS, ROUNDS, TOLERANCE, SEED, "vec_id")


def dims(centroids: DataFrame) -> DataFrame:
    """One row per cluster and dimension."""
    return centroids.select("cluster", F.posexplode("center").alias("dim", "x")).withColumn("x", F.round("x", 6))


POINTS = "with points as materialized (select vec_id, label, embedding::double[] as p from embeddings)"
START = (
    f"c0 as materialized (select (row_number() over (order by md5(vec_id::varchar || '|{SEED}'), vec_id) - 1)::int as cluster,"
    f" p as center from points order by md5(vec_id::varchar || '|{SEED}'), vec_id limit {CLUSTERS})"
)


def assign_sql(i: int) -> str:
    return (
        f"a{i} as materialized (select vec_id, any_value(label) as label, any_value(p) as p, arg_min(cluster,"
        f" row(list_distance(p, center), cluster)) as cluster from points cross join c{i} group by vec_id)"
    )


def update_sql(i: int) -> str:
    return (
        f"m{i} as materialized (select cluster, list(x order by dim) as center from (select cluster, dim, avg(p[dim]) as x"
        f" from a{i} cross join range(1, 65) as r(dim) group by cluster, dim) group by cluster),"
        f" c{i + 1} as materialized (select o.cluster, coalesce(m.center, o.center) as center from c{i} o left join m{i} m"
        " using (cluster))"
    )


def fit_sql() -> str:
    """CTEs up to the final centroids ``c`` and assignment ``a``; a converged round repeats its centroids."""
    steps = [POINTS, START]
    for i in range(ROUNDS):
        moved = f"(select sum(list_distance(n.center, o.center) ** 2) from c{i} o join n{i + 1} n using (cluster))"
        steps.append(assign_sql(i))
        steps.append(update_sql(i).replace(f"c{i + 1} as", f"n{i + 1} as"))
        steps.append(
            f"c{i + 1} as materialized (select o.cluster, case when sqrt({moved}) < {TOLERANCE} then o.center else n.center end"
            f" as center from c{i} o join n{i + 1} n using (cluster))"
        )
    steps.append(assign_sql(ROUNDS))
    return ", ".join(steps)


FIT = fit_sql()
LAST_C, LAST_A = f"c{ROUNDS}", f"a{ROUNDS}"
DIMS = "select cluster, (dim - 1)::int as dim, round(center[dim], 6) as x from {} cross join range(1, 65) as r(dim)"
LABELS = (
    f"counted as (select cluster, label, count(*) as n from {LAST_A} group by 1, 2), labels as (select c.cluster,"
    " coalesce((select label from counted k where k.cluster = c.cluster order by n desc, label limit 1), -1) as label"
    f" from {LAST_C} c)"
)


@query("k1_init", f"{POINTS}, {START} {DIMS.format('c0')}")
def _(spark, sf_dir):
    return dims(start(points(spark, sf_dir)))


@query("k2_assign", f"{POINTS}, {START}, {assign_sql(0)} select vec_id, cluster from a0")
def _(spark, sf_dir):
    rows = points(spark, sf_dir)
    return K.assign(rows, start(rows)).select("vec_id", "cluster")


@query("k3_update", f"{POINTS}, {START}, {assign_sql(0)}, {update_sql(0)} {DIMS.format('c1')}")
def _(spark, sf_dir):
    rows = points(spark, sf_dir)
    first = start(rows)
    return dims(K.update(K.assign(rows, first), first))


@query("k4_fit", f"{FIT} {DIMS.format(LAST_C)}")
def kmeans_fit(spark, sf_dir):
    return dims(fitted(spark, sf_dir))


@query("k5_cluster_labels", f"{FIT}, {LABELS} select * from labels")
def _(spark, sf_dir):
    centroids = fitted(spark, sf_dir)
    return K.cluster_labels(K.assign(points(spark, sf_dir), centroids), centroids)


@query(
    "k6_predict",
    f"{FIT}, {LABELS} select vec_id, a.label, labels.label as prediction from {LAST_A} a join labels using (cluster)",
)
def _(spark, sf_dir):
    rows, centroids = points(spark, sf_dir), fitted(spark, sf_dir)
    labels = K.cluster_labels(K.assign(rows, centroids), centroids)
    return K.kmeans_predict(rows, centroids, labels).select("vec_id", "label", "prediction")


# Four fifths of every class are held out, the clusters learned from the rest.
PART = (
    "with whole as materialized (select vec_id, label, embedding::double[] as p, row_number() over (partition by label order by"
    f" md5(vec_id::varchar || '|{SEED}'), vec_id) <= floor(count(*) over (partition by label) * 0.8::double + 0.5) as held"
    " from embeddings), points as materialized (select vec_id, label, p from whole where not held)"
)
JUDGED = (
    f"{FIT.replace(POINTS, PART)}, {LABELS}, placed as (select vec_id, any_value(label) as label, arg_min(cluster,"
    f" row(list_distance(p, center), cluster)) as cluster from whole cross join {LAST_C} where held group by vec_id),"
    " judged as (select p.label, (p.label = k.label)::int as hit from placed p join labels k using (cluster)),"
    " recalls as (select label, avg(hit) as recall from judged group by 1)"
    " select round((select avg(recall) from recalls), 9) as balanced_accuracy, round((select avg(hit) from judged), 9) as accuracy"
)


@query("k6_holdout_check", JUDGED)
def _(spark, sf_dir):
    judged = cluster_holdout(points(spark, sf_dir), "vec_id", CLUSTERS, 0.8, SEED, ROUNDS)
    return judged.select(*[F.round(c, 9).alias(c) for c in ("balanced_accuracy", "accuracy")])


@query(
    "x9_distance",
    f"{POINTS}, {START} select vec_id, round(list_distance(p, (select center from c0 where cluster = 0)), 6) as distance"
    " from points",
)
def _(spark, sf_dir):
    rows = points(spark, sf_dir)
    # One center.
    origin = F.lit(start(rows).where("cluster = 0").first()["center"])
    return rows.select("vec_id", F.round(distance("features", origin), 6).alias("distance"))


@query(
    "u2_stack_points",
    f"{POINTS}, {START} select 'row' as kind, vec_id as id, round(list_sum(p), 6) as total from points union all"
    " select 'centroid', cluster::bigint, round(list_sum(center), 6) from c0",
)
def _(spark, sf_dir):
    rows = points(spark, sf_dir)
    stacked = K.stack_points(rows, start(rows), "vec_id")
    total = F.aggregate("point", F.lit(0.0), lambda acc, x: acc + x)
    return stacked.select("kind", "id", F.round(total, 6).alias("total"))


@query("k7_pca")
def _(spark, sf_dir):
    projected, _ = K.pca_project(points(spark, sf_dir), fitted(spark, sf_dir), 30, "vec_id")
    return projected


# Signs of components are free, but a full rotation keeps every point's distance from the common mean.
TURNED = (
    f"{FIT}, stacked as (select 'row' as kind, vec_id as id, list_transform(embedding, lambda x: x::double) as p from embeddings"
    f" union all select 'centroid', cluster, center from {LAST_C}), cells as (select kind, id, dim, p[dim] as x from stacked"
    " cross join range(1, 65) as r(dim)), means as (select dim, avg(x) as m from cells group by 1)"
    " select kind, id::bigint as id, round(sum((x - m) * (x - m)), 6) as squares from cells join means using (dim) group by 1, 2"
)


@query("k7_pca_keeps_distances", TURNED)
def _(spark, sf_dir):
    projected, _ = K.pca_project(points(spark, sf_dir), fitted(spark, sf_dir), 64, "vec_id")
    squares = F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x)
    return projected.select("kind", "id", F.round(squares, 6).alias("squares"))


@query(
    "s6_centroids",
    f"{FIT}, {LABELS} select cluster, label, round(list_sum(center), 6) as total from {LAST_C} join labels using (cluster)",
)
def _(spark, sf_dir):
    centroids = fitted(spark, sf_dir)
    labels = K.cluster_labels(K.assign(points(spark, sf_dir), centroids), centroids)
    path = scratch_path(spark, "clusters")
    storage.save_centroids(centroids, labels, path)
    loaded, named = storage.load_centroids(spark, path)
    total = F.aggregate("center", F.lit(0.0), lambda acc, x: acc + x)
    return loaded.join(named, "cluster").select("cluster", "label", F.round(total, 6).alias("total"))
