"""Properties that hold for any data, and hot keys against brute force."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import SNAPSHOT, UNTIL, order_lines, table
from repurchase.functions.ordering import spans
from repurchase.operators import clusters, metrics, ranking
from repurchase.operators.boosting import BoostedModel, score_boosted, train_boosted
from repurchase.operators.decisions import label_top_n
from repurchase.operators.ranking import exact_quantiles, running_totals, with_position
from repurchase.operators.months import month_state, snapshot_from_months
from repurchase.operators.rolling import daily_sums, rolling_features, rolling_features_at
from repurchase.operators.snapshot import snapshot_features
from repurchase.operators.splits import ordered_split, stratified_split
from repurchase.operators.training import score, train_gbt
from repurchase.runtime import join_null_safe
from repurchase.schema import BoostParams, GbtParams

SF_DIR = "/root/testdata/sf0.001"
TX = ("customer_id", "order_pay_time", "order_total_payment", "order_total_num")
FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture
def monkeypatch_module(monkeypatch):
    """One that hypothesis may use in several examples of a test."""
    return monkeypatch


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows over 16 partitions: a third share one score, a third one class."""
    rng = random.Random(3)
    data = []
    for i in range(3000):
        data.append((i, 0.25 if i % 3 == 0 else round(rng.random(), 3), "big" if rng.random() < 0.9 else "small"))
    rng.shuffle(data)
    return spark.createDataFrame(data, "id long, score double, class string").repartition(16).persist()


def test_positions_with_a_hot_score(hot):
    data = sorted(((r.score, r.id) for r in hot.collect()), key=lambda x: (-x[0], x[1]))
    want = {i: at + 1 for at, (_, i) in enumerate(data)}
    placed = with_position(hot, [F.col("score").desc(), F.col("id")])
    assert {r.id: r.position for r in placed.collect()} == want
    assert label_top_n(hot, "score", 700, "id").where("result = 1").count() == 700


def test_running_totals_with_a_hot_group(hot):
    want = {}
    for name in ("big", "small"):
        sums = 0
        for i, w in sorted((r.id, r.id % 7) for r in hot.collect() if r["class"] == name):
            sums += w
            want[i] = sums
    got = running_totals(hot, {"w": F.col("id") % 7}, [F.col("id")], ["class"])
    assert {r.id: r.w for r in got.collect()} == want


def test_quantiles_equal_numpy(hot):
    found = exact_quantiles(hot, ["score", "id"], (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)).collect()
    for row in found:
        values = [r[row.column_name] for r in hot.collect()]
        assert row.quantiles == pytest.approx(list(np.quantile(values, (0.0, 0.1, 0.25, 0.5, 0.99, 1.0))))


@pytest.mark.parametrize("share", [0.2, 0.8])
def test_split_parts_are_disjoint_complete_and_exact(hot, share):
    train, holdout = stratified_split(hot, "class", share, 42, "id")
    a, b = ({r.id for r in part.collect()} for part in (train, holdout))
    assert not a & b and len(a | b) == 3000
    for name in ("big", "small"):
        n = hot.where(F.col("class") == name).count()
        assert holdout.where(F.col("class") == name).count() == int(n * share + 0.5)
    again = stratified_split(hot.repartition(3), "class", share, 42, "id")[1]
    assert {r.id for r in again.collect()} == b
    close = stratified_split(hot, "class", share, 42, "id", exact=False)[1].count()
    assert abs(close - 3000 * share) < 150


def test_ordered_split(hot):
    first, rest = ordered_split(hot, "id", 0.8)
    assert first.agg(F.max("id"), F.count("*")).first()[:] == (2399, 2400)
    assert rest.agg(F.min("id"), F.count("*")).first()[:] == (2400, 600)


def test_null_keys_meet_null_keys(spark, hot):
    names = spark.createDataFrame([("big", 1), ("small", 2), (None, 3)], "class string, code int")
    some = hot.select("id", F.when(F.col("id") % 5 != 0, F.col("class")).alias("class"))
    joined = join_null_safe(some, names, ["class"])
    assert joined.columns == ["id", "class", "code"] and joined.count() == 3000
    assert {(r["class"], r.code) for r in joined.collect()} == {("big", 1), ("small", 2), (None, 3)}
    few = join_null_safe(some, names.where("code = 2"), ["class"], "left")
    assert few.where("code is null").count() == 3000 - some.where("class = 'small'").count()


@FEW
@given(st.integers(1, 12), st.integers(0, 10_000))
def test_snapshot_ignores_order_and_partitioning(spark, partitions, seed):
    tx = order_lines(spark, SF_DIR).where("customer_id <= 20")
    spec = SNAPSHOT
    exact = [c for c in snapshot_features(tx, UNTIL, spec).columns if not c.endswith("_std")]
    shuffled = tx.repartition(partitions, F.xxhash64("goods_id", F.lit(seed)))
    plain = snapshot_features(tx, UNTIL, spec).select(exact)
    assert plain.exceptAll(snapshot_features(shuffled, UNTIL, spec).select(exact)).count() == 0


@FEW
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=2, max_size=60))
def test_auc_depends_on_the_order_of_scores_only(spark, pairs):
    df = spark.createDataFrame([(s / 10, label) for s, label in pairs], "score double, label int")
    plain = metrics.roc_auc(df, "label", "score").first()[0]
    mapped = metrics.roc_auc(df.withColumn("score", F.exp("score") * 3 - 1), "label", "score").first()[0]
    assert plain == mapped
    assert plain is None or 0.0 <= plain <= 1.0


def test_more_rounds_never_raise_the_inertia(spark):
    points = table(spark, SF_DIR, "embeddings").withColumnRenamed("embedding", "features").persist()
    rows = np.array([r.features for r in points.collect()])
    inertia = []
    for rounds in (0, 1, 2, 5, 30):
        centers = clusters.kmeans_fit(points, 10, rounds, key="vec_id").orderBy("cluster").collect()
        off = rows[:, None, :] - np.array([c.center for c in centers])[None]
        inertia.append((off**2).sum(2).min(1).sum())
    assert all(later <= earlier + 1e-9 for earlier, later in zip(inertia, inertia[1:]))


def test_pca_components_are_ordered_and_uncorrelated(spark):
    points = table(spark, SF_DIR, "embeddings").withColumnRenamed("embedding", "features")
    centroids = clusters.init_centroids(points, 10, 42, "vec_id")
    projected, shares = clusters.pca_project(points, centroids, 30, "vec_id")
    values = np.array([r.components for r in projected.collect()])
    assert values.shape == (510, 30) and shares == sorted(shares, reverse=True)
    covariance = np.cov(values.T)
    assert np.allclose(covariance, np.diag(np.diag(covariance)), atol=1e-9)
    assert np.allclose(values.mean(0), 0, atol=1e-9)


def test_trees_find_a_planted_signal_and_repeat(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(400):
        x, noise = float(rng.random()), float(rng.random())
        data.append((i, x if i % 50 else None, noise, int(x + 0.2 * noise > 0.6)))
    df = spark.createDataFrame(data, "customer_id long, x double, noise double, label int").repartition(4, "customer_id")
    params = GbtParams(max_iter=5, step_size=0.2, max_depth=3, seed=7)
    runs = []
    for _ in range(2):
        scores = score(train_gbt(df, ["x", "noise"], "label", params), df, ["x", "noise"], ["customer_id", "label"])
        assert scores.where("score is null").count() == 0
        runs.append(sorted(map(tuple, scores.collect())))
        assert metrics.roc_auc(scores, "label", "score").first()[0] > 0.9
    assert runs[0] == runs[1]


@FEW
@given(
    st.lists(st.one_of(st.none(), st.integers(-3, 3), st.integers(-(2**62), 2**62)), min_size=1, max_size=80),
    st.integers(1, 9),
)
def test_ranks_by_brackets_equal_sorting(spark, monkeypatch_module, values, few):
    """With next to nothing gathered or drawn, so that brackets have to narrow round by round."""
    monkeypatch_module.setattr(ranking, "FEW", few)
    monkeypatch_module.setattr(ranking, "DRAWN", (3, 5))
    df = spark.createDataFrame([(v, None if v is None else f"k{v}") for v in values], "n long, s string").repartition(3)
    known = sorted(v for v in values if v is not None)
    texts = sorted(f"k{v}" for v in known)
    every = list(range(len(known)))
    found = ranking.ranked_values(df, {"n": every, "s": every[::3]}, {"n": len(known), "s": len(known)})
    assert found["n"] == dict(enumerate(known))
    assert found["s"] == {r: texts[r] for r in every[::3]}


def test_cuts_among_equal_missing_and_nan_scores(spark, monkeypatch_module):
    monkeypatch_module.setattr(ranking, "FEW", 20)
    monkeypatch_module.setattr(ranking, "DRAWN", (30, 40))
    rng = random.Random(4)
    rows = [(i, rng.choice([0.5, 0.5, 0.25, None, float("nan"), float("-inf"), -0.0, 0.0, round(rng.random(), 2)])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, score double").repartition(5)
    missing = lambda s: s is None or s != s
    order = sorted(rows, key=lambda r: (missing(r[1]), 0 if missing(r[1]) else -r[1], r[0]))
    ns = [0, 1, 2, 60, 300, 333, 480, 650, 699, 700, 701]
    cuts = ranking.cut_rows(df, "score", "id", ns)
    assert cuts[0] is None and cuts[701] is None
    for n in ns[1:-1]:
        chosen = df.where(ranking.upto_cut(df, "score", "id", cuts[n]))
        assert {r.id for r in chosen.collect()} == {i for i, _ in order[:n]}
        assert label_top_n(df, "score", n, "id").where("result = 1").count() == n


@FEW
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=200))
def test_slices_rise_with_the_value(spark, values):
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v double")
    rows = df.select("v", ranking.number_slice(F.col("v"), 64).alias("s")).collect()
    ordered = sorted(rows, key=lambda r: r.v)
    assert all(a.s <= b.s for a, b in zip(ordered, ordered[1:]))
    totals = ranking.sliced_totals(df, {"n": F.lit(1)}, [F.col("v")], ranking.number_slice(F.col("v"), 64))
    assert sorted(r.n for r in totals.collect()) == list(range(1, len(values) + 1))


def test_many_cutoffs_equal_single_runs(spark):
    daily = daily_sums(order_lines(spark, SF_DIR, *TX), "2000-01-01", decimals=4).persist()
    untils = ("2000-01-02", "2000-09-17", "2001-07-02", "2003-01-01")
    many = rolling_features_at(daily, untils, label=True)
    for until in untils:
        one = rolling_features(daily, until, label=True)
        got = many.where(F.col("until") == F.lit(until).cast("date")).select(one.columns)
        rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in one.dtypes]
        assert got.count() == one.count()
        assert got.select(rounded).exceptAll(one.select(rounded)).count() == 0


def test_months_merge_to_the_same_features(spark):
    """Any split into months, a single one included, gives the features of all lines; deviations of large values, too."""
    tx = order_lines(spark, SF_DIR).where("customer_id <= 40").withColumn("goods_price", F.col("goods_price") + 1e7)
    known = spans(tx, SNAPSHOT.order)
    state = month_state(tx, SNAPSHOT, known).persist()
    for until in ("1995-01-10 00:00:00", "1998-06-01 00:00:00", UNTIL, "2030-01-01 00:00:00"):
        want = snapshot_features(tx, until, SNAPSHOT, known)
        got = snapshot_from_months(state, tx, until, SNAPSHOT, known).select(want.columns)
        rounded = [F.round(c, 5).alias(c) if c.endswith("_std") else F.col(c) for c in want.columns]
        assert want.count() == got.count()
        assert want.select(rounded).exceptAll(got.select(rounded)).count() == 0


def test_bounds_give_the_same_centers_bit_for_bit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(40, 6)) * 4
    data = [(i, [float(x) for x in np.round(middle[i % 40] + rng.normal(size=6), 1)]) for i in range(3000)]
    # Repeated points make ties between centers.
    df = spark.createDataFrame(data + [(3000 + i, data[i % 7][1]) for i in range(300)], "vec_id long, features array<double>").repartition(4)
    found = {}
    for start in (1000, 2):
        monkeypatch.setattr(clusters, "BOUNDED_FROM", start)
        for k in (2, 40, 60):
            fitted = clusters.kmeans_fit(df, k, 25, key="vec_id").orderBy("cluster").collect()
            found.setdefault(k, []).append([list(c.center) for c in fitted])
    assert all(a == b for a, b in found.values())


def boosting_rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(300):
        x, y = float(rng.random()), float(np.round(rng.random(), 1))
        data.append((i, x if i % 40 else None, y, float("inf") if i % 70 == 3 else 1.0, int(x + 0.3 * y > 0.7) if i % 9 else None))
    return spark.createDataFrame(data, "customer_id long, x double, y double, z double, label int").repartition(3, "customer_id")


PENALISED = BoostParams(max_iter=12, step_size=0.3, max_depth=3, l1=0.25, l2=0.5, min_instances=3, seed=5, store_every=5)


def test_boosted_trees_follow_the_penalised_newton_step(spark):
    df, columns = boosting_rows(spark), ["x", "y", "z"]
    model = train_boosted(df, columns, "label", PENALISED)
    rows = [r for r in df.collect() if r.label is not None]
    clean = [[v if v is not None and np.isfinite(v) else 0.0 for v in (r.x, r.y, r.z)] for r in rows]
    label = np.array([r.label for r in rows], dtype=float)

    def leaf(tree, point):
        while not isinstance(tree, int):
            tree = tree[2] if point[tree[0]] <= tree[1] else tree[3]
        return tree

    margin = np.full(len(rows), np.log(label.mean() / (1 - label.mean())))
    assert model.base == pytest.approx(margin[0])
    loss = []
    for tree, values in zip(model.trees, model.values):
        p = 1 / (1 + np.exp(-margin))
        loss.append(-np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)))
        leaves = np.array([leaf(tree, c) for c in clean])
        for i, value in enumerate(values):
            g, h = (p - label)[leaves == i].sum(), (p * (1 - p))[leaves == i].sum()
            assert value == pytest.approx(-0.3 * np.sign(g) * max(abs(g) - 0.25, 0) / (h + 0.5))
        margin += np.array(values)[leaves]
    assert len(model.trees) == 12 and all(b < a for a, b in zip(loss, loss[1:]))
    scored = {r.customer_id: r.score for r in score_boosted(model, df, ["customer_id", "label"], trees_at_once=5).collect()}
    assert len(scored) == 300
    assert [scored[r.customer_id] for r in rows] == pytest.approx(list(1 / (1 + np.exp(-margin))))
    assert metrics.roc_auc(score_boosted(model, df, ["label"]), "label", "score").first()[0] > 0.95


def test_a_fit_that_was_stopped_goes_on(spark, tmp_path):
    df, columns = boosting_rows(spark), ["x", "y", "z"]
    whole = train_boosted(df, columns, "label", PENALISED)
    train_boosted(df, columns, "label", replace(PENALISED, max_iter=7), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["after-000000", "after-000005", "after-000007"]
    again = train_boosted(df, columns, "label", PENALISED, str(tmp_path))
    assert again.trees == whole.trees
    assert [v for t in again.values for v in t] == pytest.approx([v for t in whole.values for v in t])
    assert BoostedModel.loads(again.dumps()).dumps() == again.dumps()
    for some in ("label = 1", "label is null"):
        one = train_boosted(df.where(some), columns, "label", PENALISED)
        assert one.trees == () and score_boosted(one, df, ["label"]).count() == 300
