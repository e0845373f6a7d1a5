"""Every training plan on a few hand-made customers, with few rounds: what must hold whatever the trees are."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from repurchase.plans import forecast
from repurchase.schema import BoostParams, GbtParams

FEW = GbtParams(max_iter=4, step_size=0.3, max_depth=3, seed=3)


def customers(spark, n, seed, label=True):
    """A table with a signal in ``x``, a constant, a column of nulls and gaps."""
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        x, noise = float(rng.random()), float(rng.random())
        data.append((i, x, noise if i % 6 else None, 1.0, None, int(x + 0.1 * noise > 0.75)))
    df = spark.createDataFrame(data, "customer_id long, x double, noise double, same double, none double, label int")
    return df if label else df.drop("label")


@pytest.fixture(scope="module")
def train(spark):
    return customers(spark, 240, 1).persist()


@pytest.fixture(scope="module")
def later(spark):
    return customers(spark, 90, 2, label=False).persist()


@pytest.fixture(scope="module")
def template(spark):
    # Customers nobody has seen before are among them, and some known ones are not.
    return spark.range(10, 130).select(F.col("id").alias("customer_id"), F.lit(0.0).alias("result"))


@pytest.mark.parametrize("n", [0, 17, 120, 500])
def test_ranked_forecast_marks_as_many_as_asked(train, later, template, n):
    got = forecast.ranked_forecast(train, later, template, n, FEW).collect()
    assert [r.customer_id for r in got] == list(range(10, 130))
    assert sum(r.result for r in got) == min(n, 120)


def test_ranked_forecast_prefers_what_the_signal_prefers(train, later, template):
    marked = {r.customer_id for r in forecast.ranked_forecast(train, later, template, 15, FEW).where("result = 1").collect()}
    x = {r.customer_id: r.x for r in later.collect()}
    assert all(c in x for c in marked)
    others = [x[c] for c in x if 10 <= c < 90 and c not in marked]
    assert np.mean([x[c] for c in marked]) > np.mean(others) + 0.2


def test_selected_forecast_uses_informative_features(train, later, template):
    got = forecast.selected_forecast(train, later, template, 1, 15, FEW)
    assert got.where("result = 1").count() == 15
    x = {r.customer_id: r.x for r in later.collect()}
    assert min(x[r.customer_id] for r in got.where("result = 1").collect()) > 0.5


def test_threshold_forecast_marks_nobody_unseen(train, later, template):
    got = forecast.threshold_forecast(train, later, template, 0.4, FEW)
    assert got.count() == 120 and got.where("customer_id >= 90 and result = 1").count() == 0
    assert 5 <= got.where("result = 1").count() <= 45


def test_checks_find_the_signal(train):
    assert forecast.stratified_check(train, 0.4, params=FEW).first()[0] > 0.8
    assert forecast.weighted_check(train, params=FEW).first()[0] > 0.8
    auc, right = forecast.ordered_check(train, params=FEW).first()
    assert auc > 0.9 and right > 0.8
    swept = {r.n: r.balanced_accuracy for r in forecast.sweep_check(train, (0, 5, 12, 48), params=FEW).collect()}
    assert swept[0] == swept[48] == 0.5 and swept[12] > 0.8
    few = BoostParams(max_iter=6, step_size=0.3, max_depth=3, l1=0.25, l2=0.25, min_instances=3, seed=1, store_every=4)
    auc, right = forecast.boosted_check(train, params=few).first()
    assert auc > 0.9 and right > 0.8


def test_weights_find_a_rare_class(spark):
    rare = customers(spark, 400, 5).where("label = 0 or customer_id % 9 = 0")
    plain, weighted = (check(rare, 0.5, params=FEW).first()[0] for check in (forecast.stratified_check, forecast.weighted_check))
    assert weighted >= plain and weighted > 0.8


def test_cluster_check_is_a_share(train):
    balanced, right = forecast.cluster_check(train.na.fill(0.0).drop("none", "same"), k=4).first()
    assert 0.4 < balanced <= 1.0 and 0.4 < right <= 1.0
