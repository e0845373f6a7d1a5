"""Training jobs with the unaltered depth-wise settings; scores depend on the learner, so only rows can be compared.

The leaf-wise settings have 2,500 rounds and are not registered: no shorter run would stand for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import DENSE, DENSE_START, SNAPSHOT, UNTIL, event_lines, order_lines, order_spans
from repurchase.catalog.registry import query
from repurchase.catalog.tables import template
from repurchase.operators.rolling import daily_sums, rolling_features
from repurchase.operators.splits import stratified_split
from repurchase.operators.training import fit_evaluate, fit_predict
from repurchase.plans import forecast
from repurchase.plans.dataset import snapshot_dataset
from repurchase.runtime import scratch_path
from repurchase.schema import DEPTHWISE
from repurchase.sources.storage import load_features, read_template, save_features, write_submission

TRAIN_UNTIL, SCORE_UNTIL = "2024-01-22", "2024-01-29"
# The score table is taken three months after the training table.
SNAPSHOT_LATER = "2001-08-31 23:59:59"


def saved(spark, df: DataFrame) -> DataFrame:
    """Features are written before training, which reads them once per tree level."""
    path = scratch_path(spark, "features")
    save_features(df, path)
    return load_features(spark, path)


def labelled(spark, sf_dir) -> DataFrame:
    daily = daily_sums(event_lines(spark, sf_dir), DENSE_START)
    return saved(spark, rolling_features(daily, TRAIN_UNTIL, DENSE, label=True))


def unlabelled(spark, sf_dir) -> DataFrame:
    daily = daily_sums(event_lines(spark, sf_dir), DENSE_START)
    return saved(spark, rolling_features(daily, SCORE_UNTIL, DENSE))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def holdout_scores(params):
    def run(spark, sf_dir):
        train, holdout = stratified_split(labelled(spark, sf_dir), "label", 0.2, 42, "customer_id")
        columns = forecast.feature_columns(train)
        return rounded(fit_evaluate(train, holdout, columns, "customer_id", "label", params))

    return run


query("t4_gbt_depthwise")(holdout_scores(DEPTHWISE))


@query("t5_stratified_check")
def _(spark, sf_dir):
    return rounded(forecast.stratified_check(labelled(spark, sf_dir), params=DEPTHWISE))


@query("t5_weighted_check")
def _(spark, sf_dir):
    return rounded(forecast.weighted_check(labelled(spark, sf_dir), params=DEPTHWISE))


@query("t5_ordered_check")
def _(spark, sf_dir):
    return rounded(forecast.ordered_check(labelled(spark, sf_dir), params=DEPTHWISE))


@query("t6_fit_predict")
def _(spark, sf_dir):
    train = labelled(spark, sf_dir)
    columns = forecast.feature_columns(train)
    return rounded(fit_predict(train, unlabelled(spark, sf_dir), columns, "customer_id", "label", DEPTHWISE))


@query("t6_ranked_forecast")
def _(spark, sf_dir):
    return forecast.ranked_forecast(
        labelled(spark, sf_dir), unlabelled(spark, sf_dir), template(spark, sf_dir), 50, DEPTHWISE
    )


@query("t6_threshold_forecast")
def _(spark, sf_dir):
    return forecast.threshold_forecast(
        labelled(spark, sf_dir), unlabelled(spark, sf_dir), template(spark, sf_dir), 0.4, DEPTHWISE
    )


@query("t5_model_sweep")
def _(spark, sf_dir):
    return rounded(forecast.sweep_check(labelled(spark, sf_dir), (10, 20, 30, 40, 50, 60, 70, 80), params=DEPTHWISE))


def snapshot_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training and score table, from order lines that are joined once and spans that need no join."""
    known, lines = order_spans(spark, sf_dir), saved(spark, order_lines(spark, sf_dir))
    train = saved(spark, snapshot_dataset(lines, UNTIL, True, SNAPSHOT, known))
    return train, saved(spark, snapshot_dataset(lines, SNAPSHOT_LATER, False, SNAPSHOT, known))


@query("t6_snapshot_forecast")
def _(spark, sf_dir):
    """Snapshot features at two cutoffs, the 30 best of them, trees, top n, and the submission as written."""
    train, future = snapshot_tables(spark, sf_dir)
    judged = forecast.selected_forecast(train, future, template(spark, sf_dir), 30, 50, DEPTHWISE)
    path = scratch_path(spark, "submission")
    write_submission(judged, path)
    return read_template(spark, path)


@query("k6_cluster_check")
def _(spark, sf_dir):
    return rounded(forecast.cluster_check(labelled(spark, sf_dir)))
