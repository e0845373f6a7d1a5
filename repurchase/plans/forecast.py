"""From order lines to judged customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.functions import expressions as X
from repurchase.functions.windows import DayWindow
from repurchase.operators.boosting import score_boosted, train_boosted
from repurchase.operators.clusters import as_point, assign, cluster_labels, kmeans_fit, kmeans_predict
from repurchase.operators.decisions import attach_scores, by_threshold, label_top_n, topn_sweep
from repurchase.operators.labels import horizon_label
from repurchase.operators.metrics import accuracy, balanced_accuracy, roc_auc
from repurchase.operators.rolling import daily_sums
from repurchase.operators.scaling import minmax_scale
from repurchase.operators.selection import anova_scores, apply_selection, select_top
from repurchase.operators.splits import ordered_split, stratified_split
from repurchase.operators.training import class_weights, fit_evaluate, fit_predict, score, train_gbt, with_null_flags
from repurchase.schema import DEPTHWISE, LEAFWISE, LEAFWISE_PENALISED, BoostParams, GbtParams

KEYS = ("customer_id", "label")
# Fixed value: how many customers the published forecast marks.
BUY_NUM = 450_000


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def ranked_forecast(
    train: DataFrame, future: DataFrame, template: DataFrame, buy_num: int = BUY_NUM, params: GbtParams = DEPTHWISE
) -> DataFrame:
    """Train on a labelled table, score the later one, mark the ``buy_num`` likeliest customers.

    ``train`` and ``future`` are saved feature tables, so that training does not recompute them.
    """
    columns = feature_columns(train)
    scores = fit_predict(train, future, columns, "customer_id", "label", params)
    judged = label_top_n(attach_scores(template, scores), "score", buy_num, "customer_id")
    return judged.select("customer_id", "result").orderBy("customer_id")


def selected_forecast(
    train: DataFrame,
    future: DataFrame,
    template: DataFrame,
    n_features: int = 30,
    buy_num: int = BUY_NUM,
    params: GbtParams = DEPTHWISE,
) -> DataFrame:
    """As above with the ``n_features`` features of the highest F statistic in the training table."""
    scores = anova_scores(train, feature_columns(train), "label").where(F.col("score").isNotNull())
    names = [r["feature"] for r in select_top(scores, n_features).collect()]
    return ranked_forecast(
        apply_selection(train, names, KEYS), apply_selection(future, names, KEYS[:1]), template, buy_num, params
    )


def threshold_forecast(
    train: DataFrame, future: DataFrame, template: DataFrame, threshold: float = 0.4, params: GbtParams = LEAFWISE
) -> DataFrame:
    """As above on features scaled to the training range, marking every score above ``threshold``."""
    columns = feature_columns(train)
    scaled = [minmax_scale(df, columns, fit_on=train) for df in (train, future)]
    scores = fit_predict(scaled[0], scaled[1], columns, "customer_id", "label", params)
    return by_threshold(attach_scores(template, scores), "score", threshold).select("customer_id", "result")


def stratified_check(
    train: DataFrame, threshold: float = 0.1, share: float = 0.2, seed: int = 42, params: GbtParams = LEAFWISE
) -> DataFrame:
    """Balanced accuracy on a stratified holdout."""
    fit_on, holdout = stratified_split(train, "label", share, seed, "customer_id")
    scored = fit_evaluate(fit_on, holdout, feature_columns(train), "customer_id", "label", params)
    return balanced_accuracy(by_threshold(scored, "score", threshold), "label", "result")


def weighted_check(
    train: DataFrame, threshold: float = 0.5, share: float = 0.2, seed: int = 42, params: GbtParams = DEPTHWISE
) -> DataFrame:
    """Balanced accuracy on a stratified holdout, with classes of equal weight and flags for what was missing.

    For tables in which few customers return: without weights the learner gains by never marking one.
    """
    columns = feature_columns(train)
    flagged = class_weights(with_null_flags(train, columns), "label")
    features = [c for c in flagged.columns if c not in (*KEYS, "weight")]
    fit_on, holdout = stratified_split(flagged, "label", share, seed, "customer_id")
    model = train_gbt(fit_on, features, "label", params, weight="weight")
    scored = score(model, holdout, features, KEYS)
    return balanced_accuracy(by_threshold(scored, "score", threshold), "label", "result")


def boosted_check(
    train: DataFrame, share: float = 0.2, seed: int = 42, params: BoostParams = LEAFWISE_PENALISED, folder: str | None = None
) -> DataFrame:
    """AUC and accuracy of trees with penalised leaves on a stratified holdout; ``folder`` lets a long fit go on."""
    columns = feature_columns(train)
    fit_on, holdout = stratified_split(train, "label", share, seed, "customer_id")
    scored = score_boosted(train_boosted(fit_on, columns, "label", params, folder), holdout, KEYS)
    return roc_auc(scored, "label", "score").withColumn("accuracy", accuracy(scored, "label", "prediction").scalar())


def sweep_check(
    train: DataFrame, ns: Sequence[int], share: float = 0.2, seed: int = 42, params: GbtParams = LEAFWISE
) -> DataFrame:
    """Balanced accuracy of marking the top n of a stratified holdout, for each n."""
    fit_on, holdout = stratified_split(train, "label", share, seed, "customer_id")
    scored = fit_evaluate(fit_on, holdout, feature_columns(train), "customer_id", "label", params)
    return topn_sweep(scored, "score", "label", ns, "customer_id")


def ordered_check(train: DataFrame, share: float = 0.8, params: GbtParams = LEAFWISE) -> DataFrame:
    """AUC and accuracy on the last customers by id."""
    first, last = ordered_split(train, "customer_id", share)
    columns = feature_columns(train)
    scaled = [minmax_scale(df, columns, fit_on=train) for df in (first, last)]
    scored = fit_evaluate(scaled[0], scaled[1], columns, "customer_id", "label", params)
    auc, right = roc_auc(scored, "label", "score"), accuracy(scored, "label", "prediction")
    return auc.withColumn("accuracy", right.scalar())


def cluster_check(
    train: DataFrame, k: int = 10, holdout_share: float = 0.8, seed: int = 42, max_iter: int = 30
) -> DataFrame:
    """Balanced accuracy and accuracy of the cluster classifier, trained on the smaller part."""
    columns = feature_columns(train)
    scaled = minmax_scale(train, columns).na.fill(0.0, columns)
    points = scaled.select(*KEYS, as_point(columns).alias("features"))
    return cluster_holdout(points, "customer_id", k, holdout_share, seed, max_iter)


def cluster_holdout(points: DataFrame, key: str, k: int, holdout_share: float, seed: int, max_iter: int) -> DataFrame:
    """The same on points: key, label, features."""
    fit_on, holdout = stratified_split(points, "label", holdout_share, seed, key)
    centroids = kmeans_fit(fit_on, k, max_iter, seed=seed, key=key)
    labels = cluster_labels(assign(fit_on, centroids), centroids)
    judged = kmeans_predict(holdout, centroids, labels)
    both = balanced_accuracy(judged, "label", "prediction")
    return both.withColumn("accuracy", accuracy(judged, "label", "prediction").scalar())


def repeat_buyer_ranking(tx: DataFrame, start, until, window: int, horizon: int, n: int) -> DataFrame:
    """How well recency-weighted spend finds repeat buyers: history, one window, label, top n, metric."""
    daily = daily_sums(tx, start, decimals=4)
    spent = DayWindow(F.col("day_payment"), F.datediff(X.as_date(until), F.col("day")), window)
    ranked = daily.groupBy("customer_id").agg(
        F.round(spent.decay_sum(0.9), 4).alias("score"),
        F.round(spent.sum(), 4).alias("spent"),
        spent.days_since_last(F.col("day_payment") != 0).alias("days_since_last"),
        horizon_label(F.col("day_num"), F.col("day"), until, horizon).alias("label"),
        F.min("day").alias("_first_day"),
    )
    known = ranked.where(F.col("_first_day") < X.as_date(until)).drop("_first_day")
    return label_top_n(known, "score", n, "customer_id", name="chosen")

