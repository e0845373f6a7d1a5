"""Scaling, feature selection and splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import DENSE, DENSE_UNTIL, TX, table
from repurchase.catalog.labels import LABEL_FUTURE, label_future
from repurchase.catalog.registry import query
from repurchase.catalog.rolling import EVENT_DAILY, event_daily, rolling_sql
from repurchase.operators import selection as S
from repurchase.operators.rolling import rolling_features
from repurchase.operators.scaling import minmax_scale
from repurchase.operators.splits import ordered_split, with_holdout
from repurchase.runtime import scratch_path
from repurchase.sources.storage import load_statistics, save_features

# Windows one week earlier stand in for the training table whose ranges are reused.
EARLIER = "2024-01-15"
SCALED = ("sum_7", "max_14", "goods_sum_14", "has_sales_days_in_last_14")


def features_at(spark, sf_dir, until: str) -> DataFrame:
    features = rolling_features(event_daily(spark, sf_dir), until, DENSE).select("customer_id", *SCALED)
    # Window sums are rounded so that the range ends are equal in both engines.
    return features.withColumns({c: F.round(c, 4) for c in ("sum_7", "max_14", "goods_sum_14")})


def features_sql(until: str) -> str:
    return f"({rolling_sql(DENSE, until, lambda name: name in SCALED)})"


def scaled_sql(fit_on: str, columns) -> str:
    each = ", ".join(
        f"round(({c} - (select min({c}) from {fit_on}))::double / nullif((select max({c}) - min({c}) from {fit_on}), 0), 6) as {c}"
        for c in columns
    )
    return f"{EVENT_DAILY}, now as {features_sql(DENSE_UNTIL)}, earlier as {features_sql(EARLIER)} select customer_id, {each} from now"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


@query("n1_minmax", scaled_sql("now", SCALED))
def _(spark, sf_dir):
    return rounded(minmax_scale(features_at(spark, sf_dir, DENSE_UNTIL), SCALED))


@query("n1_minmax_from_statistics", scaled_sql("earlier", SCALED))
def _(spark, sf_dir):
    """The later table scaled to the range of the earlier one, which was measured while it was stored."""
    now, earlier = (features_at(spark, sf_dir, until) for until in (DENSE_UNTIL, EARLIER))
    path = scratch_path(spark, "features")
    save_features(earlier, path, measure=True)
    return rounded(minmax_scale(now, SCALED, known=load_statistics(spark, path)))


@query("n1_minmax_train_range", scaled_sql("earlier", SCALED))
def _(spark, sf_dir):
    now, earlier = (features_at(spark, sf_dir, until) for until in (DENSE_UNTIL, EARLIER))
    return rounded(minmax_scale(now, SCALED, fit_on=earlier))


DIMENSIONS = 64
NAMES = [f"f{i:02d}" for i in range(DIMENSIONS)]


def embedding_columns(spark, sf_dir) -> DataFrame:
    """Embedding values as feature columns, every 50th value of the first one missing."""
    values = [F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(NAMES)]
    wide = table(spark, sf_dir, "embeddings").select("vec_id", "label", *values)
    return wide.withColumn(NAMES[0], F.when(F.col("vec_id") % 50 != 0, F.col(NAMES[0])))


CELLS = (
    "raw as (select vec_id, label, 'f' || lpad((i - 1)::varchar, 2, '0') as feature, case when i = 1 and vec_id % 50 = 0"
    f" then null else embedding[i]::double end as x from embeddings, range(1, {DIMENSIONS + 1}) as r(i)),"
    " cells as (select label, feature, coalesce(x, avg(x) over (partition by feature)) as x from raw)"
)
ANOVA = (
    f"{CELLS}, per_class as (select feature, label, count(*) as n, avg(x) as m, coalesce(var_samp(x), 0) as v from cells"
    " group by 1, 2), grand as (select feature, sum(n * m) / sum(n) as g, count(*) as k, sum(n) as total from per_class"
    " group by 1), scores as (select feature, round(sum(n * (m - g) * (m - g)) / (any_value(k) - 1) /"
    " (sum((n - 1) * v) / (any_value(total) - any_value(k))), 6) as score from per_class join grand using (feature) group by 1)"
)


@query("n2_anova", f"with {ANOVA} select * from scores")
def anova(spark, sf_dir):
    return rounded(S.anova_scores(embedding_columns(spark, sf_dir), NAMES, "label"))


@query("n2_anova_top", f"with {ANOVA} select * from scores order by score desc, feature limit 30")
def _(spark, sf_dir):
    return S.select_top(anova(spark, sf_dir), 30)


BINS = 20
MUTUAL = (
    f"{CELLS}, ends as (select feature, min(x) as low, max(x) as high from cells group by 1),"
    f" binned as (select feature, label, least(floor((x - low) / (high - low) * {BINS}), {BINS - 1}) as bin from cells"
    " join ends using (feature)), joint as (select feature, bin, label, count(*) as n from binned group by 1, 2, 3),"
    " sized as (select feature, n, sum(n) over (partition by feature) as total, sum(n) over (partition by feature, bin) as"
    " in_bin, sum(n) over (partition by feature, label) as in_class from joint)"
    " select feature, round(sum(n / total * ln(n::double * total / (in_bin::double * in_class))), 6) as score from sized group by 1"
)


@query("n3_mutual_info", f"with {MUTUAL}")
def _(spark, sf_dir):
    return rounded(S.mutual_info(embedding_columns(spark, sf_dir), NAMES, "label", BINS))


CUTS = 10
BY_RANK = (
    f"{CELLS}, cuts as (select feature, quantile_cont(x, [{', '.join(f'{i} / {CUTS}.0' for i in range(1, CUTS))}]) as edge from cells group by 1),"
    f" binned as (select feature, label, {' + '.join(f'(edge[{i}] < x)::int' for i in range(1, CUTS))} as bin from cells join cuts using (feature)),"
    " joint as (select feature, bin, label, count(*) as n from binned group by 1, 2, 3),"
    " sized as (select feature, n, sum(n) over (partition by feature) as total, sum(n) over (partition by feature, bin) as"
    " in_bin, sum(n) over (partition by feature, label) as in_class from joint)"
    " select feature, round(sum(n / total * ln(n::double * total / (in_bin::double * in_class))), 6) as score from sized group by 1"
)


@query("n3_mutual_info_exact_quantiles", f"with {BY_RANK}")
def _(spark, sf_dir):
    return rounded(S.mutual_info(embedding_columns(spark, sf_dir), NAMES, "label", CUTS, method="quantile", error=0.0))


@query("n3_mutual_info_quantile")
def _(spark, sf_dir):
    return rounded(S.mutual_info(embedding_columns(spark, sf_dir), NAMES, "label", 10, method="quantile"))


@query(
    "n4_selected_features",
    f"with {ANOVA}, chosen as (select feature from scores order by score desc, feature limit 5)"
    " select vec_id, label, feature, x from raw join chosen using (feature)",
)
def _(spark, sf_dir):
    """The five features with the highest F statistic; told in long form, as the names depend on the data."""
    wide = embedding_columns(spark, sf_dir)
    names = [r["feature"] for r in S.select_top(rounded(S.anova_scores(wide, NAMES, "label")), 5).collect()]
    chosen = S.apply_selection(wide, names, ["vec_id", "label"])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in names])
    return chosen.select("vec_id", "label", F.inline(cells))


@query(
    "n4_apply_selection",
    "select vec_id, label, embedding[4]::double as f03, embedding[8]::double as f07 from embeddings",
)
def _(spark, sf_dir):
    return S.apply_selection(embedding_columns(spark, sf_dir), ["f03", "f07"], ["vec_id", "label"])


@query("n5_assemble")
def assembled(spark, sf_dir):
    return S.assemble(embedding_columns(spark, sf_dir).na.fill(0.0), NAMES).select("vec_id", "features")


@query(
    "n5_assemble_as_array",
    "select vec_id, list_transform(embedding, lambda x, i: case when i = 1 and vec_id % 50 = 0 then 0.0::double else x::double end)"
    " as features from embeddings",
)
def _(spark, sf_dir):
    return assembled(spark, sf_dir).select("vec_id", vector_to_array("features").alias("features"))


def holdout_sql(share: float, seed: int) -> str:
    return (
        f"with {TX}, {LABEL_FUTURE}, placed as (select *, row_number() over (partition by label order by"
        f" md5(customer_id::varchar || '|{seed}'), customer_id) as place, count(*) over (partition by label) as size from labelled)"
        f" select customer_id, label, place <= floor(size * {share}::double + 0.5) as holdout from placed"
    )


def holdout(share: float, seed: int, exact: bool = True):
    def run(spark, sf_dir):
        return with_holdout(label_future(spark, sf_dir), "label", share, seed, "customer_id", exact)

    return run


query("t1_stratified", holdout_sql(0.2, 42))(holdout(0.2, 42))
query("t1_stratified_large", holdout_sql(0.8, 42))(holdout(0.8, 42))
query(
    "t1_hash_share",
    f"with {TX}, {LABEL_FUTURE} select customer_id, label, ('0x' || substr(md5(customer_id::varchar || '|42'), 1, 13))::bigint"
    " / 4503599627370496.0::double < 0.2::double as holdout from labelled",
)(holdout(0.2, 42, exact=False))


@query(
    "t2_ordered",
    f"with {TX}, {LABEL_FUTURE}, placed as (select *, row_number() over (order by customer_id) as place, count(*) over () as size"
    " from labelled) select customer_id, label, case when place <= floor(size * 0.8::double) then 'train' else 'holdout' end"
    " as part from placed",
)
def _(spark, sf_dir):
    first, rest = ordered_split(label_future(spark, sf_dir), "customer_id", 0.8)
    return first.withColumn("part", F.lit("train")).unionByName(rest.withColumn("part", F.lit("holdout")))
