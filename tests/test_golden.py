"""Hand-made tables for the rules that are easy to get wrong."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from repurchase.functions import expressions as X
from repurchase.functions import ordering
from repurchase.functions.windows import DayWindow
from repurchase.operators import clean, clusters, decisions, labels, metrics, profile, rolling, selection, snapshot, splits
from repurchase.operators.ranking import running_totals
from repurchase.operators.scaling import minmax_scale
from repurchase.operators.training import class_weights, with_null_flags
from repurchase.schema import NULLABLE_COLUMNS, ORDER_LINE_COLUMNS, RollingSpec, SnapshotSpec
from repurchase.sources.storage import write_submission
from repurchase.sources.transactions import conform, read_transactions, split_transactions

UNTIL = date(2024, 3, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def order_line(spark, *entries):
    """Order lines given as dicts; unnamed columns get the same value in every line."""
    plain = {"long": 1, "int": 1, "double": 2.0, "string": "x", "timestamp_ntz": datetime(2024, 1, 1, 10, 0, 0)}
    schema = ", ".join(f"{name} {kind}" for name, kind in ORDER_LINE_COLUMNS)
    data = [tuple(entry.get(name, plain[kind]) for name, kind in ORDER_LINE_COLUMNS) for entry in entries]
    return spark.createDataFrame(data, schema)


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


# --- snapshot ----------------------------------------------------------------------------------


def test_last_value_skips_nulls_per_column(spark):
    tx = order_line(
        spark,
        {"customer_id": 7, "order_detail_id": 1, "order_pay_time": at(1), "goods_price": 5.0, "member_status": 1},
        {"customer_id": 7, "order_detail_id": 2, "order_pay_time": at(2), "goods_price": None, "member_status": 0},
    )
    got = snapshot.snapshot_features(tx, "2024-01-31").first()
    assert (got["goods_price_last"], got["member_status_last"]) == (5.0, 0)


def test_equal_times_are_decided_by_the_following_ids(spark):
    tx = order_line(
        spark,
        {"customer_id": 7, "order_detail_id": 9, "order_id": 1, "goods_id": 100},
        {"customer_id": 7, "order_detail_id": 8, "order_id": 2, "goods_id": 200},
        {"customer_id": 7, "order_detail_id": 7, "order_id": 2, "goods_id": 300},
    )
    assert snapshot.snapshot_features(tx, "2024-01-31").first()["goods_id_last"] == 200


def test_declared_columns_with_nulls_are_refused_and_undeclared_ones_handled(spark):
    tx = order_line(
        spark,
        {"customer_id": 7, "order_detail_id": 1, "order_pay_time": at(1), "order_amount": 5.0},
        {"customer_id": 7, "order_detail_id": 2, "order_pay_time": at(2), "order_amount": None},
    )
    with pytest.raises(Exception, match="order_amount holds nulls"):
        snapshot.snapshot_features(tx, "2024-01-31", SnapshotSpec(nullable=NULLABLE_COLUMNS, packed=False)).collect()
    # A malformed cell became null on reading; by default the value before it counts.
    for spec in (SnapshotSpec(), SnapshotSpec(packed=False), SnapshotSpec(nullable=NULLABLE_COLUMNS)):
        assert snapshot.snapshot_features(tx, "2024-01-31", spec).first()["order_amount_last"] == 5.0


WIDE = "time timestamp_ntz, a long, b double, c date, v int"


@pytest.mark.parametrize("reach, packs", [(9, "long"), (10**14, "decimal"), (2**62, None)])
def test_packed_orders_equal_the_struct(spark, reach, packs):
    rng = random.Random(reach)
    rows = [
        (
            None if i % 9 == 0 else datetime(2024, 1, 1 + rng.randrange(28), microsecond=rng.randrange(2) if packs == "decimal" else 0),
            None if i % 7 == 0 else rng.randrange(-reach, reach),
            None if i % 5 == 0 else float(rng.randrange(-reach, reach)) if packs != "decimal" else float(rng.randrange(-9, 9)),
            None if i % 4 == 0 else date(2024, 2, 1 + rng.randrange(20)),
            i,
        )
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, WIDE)
    order = ("time", "a", "b", "c", "v")
    key = ordering.packed(df, order, ordering.spans(df, order))
    if packs is None:
        assert key is None
        return
    keyed = df.withColumn("key", key)
    assert dict(keyed.dtypes)["key"] == {"long": "bigint", "decimal": "decimal(38,0)"}[packs]
    got = [r.v for r in keyed.orderBy("key").collect()]
    assert got == [r.v for r in df.orderBy(F.struct(*order)).collect()]
    assert keyed.select("key").distinct().count() == len(rows)


def test_spans_take_the_widest_unit_and_refuse_what_lies_outside(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 5), 0.5, "x"), (datetime(1969, 12, 30), 2.0, "y")], "t timestamp_ntz, d double, s string")
    known = ordering.spans(df, ("t", "d", "s"))
    assert known == {"t": ordering.Span(-2, 19727, "DAY")}
    assert ordering.packed(df, ("t", "s"), known) is None
    later = spark.createDataFrame([(datetime(2024, 1, 6),), (datetime(2024, 1, 5, 0, 0, 1),)], "t timestamp_ntz")
    with pytest.raises(Exception, match="outside the span"):
        later.select(ordering.packed(later, ("t",), known)).collect()
    both = ordering.merged(known, ordering.spans(later, ("t",)))
    assert both["t"].unit == "SECOND" and later.select(ordering.packed(later, ("t",), both)).distinct().count() == 2


def test_single_line_and_all_null_columns(spark):
    tx = order_line(spark, {"customer_id": 7, "goods_price": None, "member_status": None, "customer_gender": None})
    got = snapshot.snapshot_features(tx, "2024-01-31").first()
    assert got["customer_gender"] == 0
    assert got["goods_price_mean"] is None and got["goods_price_last"] is None
    assert got["member_status_sum"] == 0.0 and got["member_status_mean"] is None
    assert got["order_total_payment_std"] is None and got["order_total_payment_mean"] == 2.0


def test_snapshot_widths_and_null_customers(spark):
    tx = order_line(spark, {"customer_id": 7}, {"customer_id": None})
    features = snapshot.snapshot_features(tx, "2024-01-31")
    assert len(features.columns) == 1 + 59 and features.count() == 1
    older = snapshot.snapshot_features(tx, "2024-01-31", SnapshotSpec(goods_num=False, discount_ratio=True))
    assert len(older.columns) == 1 + 58


def test_day_counts_round_down_before_the_epoch(spark):
    df = spark.createDataFrame([(datetime(2012, 10, 10, 23, 0),), (datetime(2012, 10, 11, 1, 0),)], "t timestamp_ntz")
    assert rows(df.select(X.days_since(date(2012, 10, 11), "t"))) == [(-1,), (0,)]


def test_exact_sums_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(1e9,), (-1e9,)], "v double")
    assert df.agg(X.total("v", 4)).first()[0] == 1.0
    assert df.where("v is null").agg(X.total("v", 4), X.mean("v", 4)).first()[:] == (0.0, None)


# --- labels ------------------------------------------------------------------------------------


def test_cutoffs(spark):
    tx = order_line(
        spark,
        {"customer_id": 1, "order_pay_time": datetime(2024, 1, 31, 23, 59, 59)},
        {"customer_id": 1, "order_pay_time": datetime(2024, 2, 1)},
        {"customer_id": 2, "order_pay_time": datetime(2024, 1, 5)},
        {"customer_id": 3, "order_pay_time": datetime(2024, 2, 5)},
    )
    until = "2024-01-31 23:59:59"
    assert labels.history(tx, until).count() == 2 and labels.future(tx, until).count() == 2
    assert rows(labels.label_future(tx, until)) == [(1, 1), (2, 0)]
    assert labels.since(tx, "2024-01-31").count() == 2


def test_horizon_ends_before_its_last_day(spark):
    daily = spark.createDataFrame(
        [(c, UNTIL + timedelta(days=d), 1.0, 1.0) for c, d in ((1, 0), (2, 29), (3, 30), (4, -1))],
        "customer_id long, day date, day_payment double, day_num double",
    )
    assert rows(labels.label_horizon(daily, UNTIL, 30)) == [(1, 1), (2, 1), (3, 0), (4, 0)]


# --- rolling windows ---------------------------------------------------------------------------


def daily_table(spark, values):
    """values: customer -> {age: payment}; the quantity is the same number."""
    data = [
        (c, UNTIL - timedelta(days=age), float(v), float(v)) for c, days in values.items() for age, v in days.items()
    ]
    return spark.createDataFrame(data, "customer_id long, day date, day_payment double, day_num double")


def test_known_window(spark):
    # Days from oldest to newest: 0, 0, 5, 0, 2.
    daily = daily_table(spark, {1: {3: 5, 1: 2}})
    w = DayWindow(F.col("day_payment"), F.datediff(F.lit(UNTIL), F.col("day")), 5)
    active = F.col("day_payment") != 0
    got = daily.groupBy("customer_id").agg(w.decay_sum(0.9), w.days_since_last(active), w.days_since_first(active)).first()
    assert got[1] == pytest.approx(6.05) and got[2:] == (1, 3)


def test_only_the_oldest_day_active_and_no_day_active(spark):
    daily = daily_table(spark, {1: {14: 5}, 2: {15: 5}})
    got = rolling.rolling_features(daily, UNTIL)
    columns = ("last_has_sales_day_in_last_14", "first_has_sales_day_in_last_14", "has_sales_days_in_last_14")
    assert rows(got.select("customer_id", *columns)) == [(1, 14, 14, 1), (2, 14, 0, 0)]


def test_against_a_zero_filled_matrix(spark):
    rng = np.random.default_rng(5)
    values = {}
    for c in range(1, 31):
        ages = rng.choice(np.arange(1, 25), size=rng.integers(1, 24), replace=False)
        values[c] = {int(a): round(float(rng.normal(0, 20)), 2) if rng.random() > 0.2 else 0.0 for a in ages}
    values[31] = {a: -1.0 for a in range(1, 25)}
    extra = ("mean", "median", "min", "std", "diff_mean", "decay_sum")
    spec = RollingSpec(payment_windows=(6, 9), goods_windows=(5, 8), extra=extra)
    got = {r["customer_id"]: r for r in rolling.rolling_features(daily_table(spark, values), UNTIL, spec).collect()}
    assert len(got) == 31
    for c, days in values.items():
        for shift, tail in ((0, ""), (7, "_2")):
            for n, prefix in ((6, ""), (9, ""), (5, "goods_"), (8, "goods_")):
                line = np.array([days.get(shift + k, 0.0) for k in range(n, 0, -1)])
                want = {
                    "max": line.max(), "min": line.min(), "median": np.median(line),
                    "decay_sum": (line * 0.9 ** np.arange(n)[::-1]).sum(),
                }
                if prefix or not shift:
                    want["diff_mean"] = np.diff(line).mean()
                    want["sum"] = line.sum()
                if not (prefix and shift):
                    want["std"] = line.std(ddof=1)
                want["mean"] = line.mean()
                for name, value in want.items():
                    assert got[c][f"{prefix}{name}_{n}{tail}"] == pytest.approx(value, abs=1e-9), (c, prefix, name, n)
                if shift:
                    continue
                active = line != 0 if not prefix else line > 0
                ages = np.arange(n, 0, -1)[active]
                found = [got[c][f"{prefix}{k}_{n}"] for k in ("has_sales_days_in_last", "last_has_sales_day_in_last", "first_has_sales_day_in_last")]
                assert found == [active.sum(), ages.min() if len(ages) else n, ages.max() if len(ages) else 0]


def test_population(spark):
    daily = daily_table(spark, {1: {3: 5}, 2: {0: 5}, 3: {-2: 5}})
    known = rolling.rolling_features(daily, UNTIL, label=True)
    everyone = rolling.rolling_features(daily, UNTIL, label=True, population="all")
    assert rows(known.select("customer_id", "label")) == [(1, 0)]
    assert rows(everyone.select("customer_id", "label", "sum_91")) == [(1, 0, 5.0), (2, 1, 0.0), (3, 1, 0.0)]
    assert len(known.columns) == 1 + 59 + 1


def test_matrix_fills_missing_days(spark):
    daily = daily_table(spark, {1: {1: 5}, 2: {9: 4}})
    got = rolling.daily_matrix(daily, [date(2024, 2, 28), date(2024, 2, 29)], "day_payment")
    assert got.columns == ["customer_id", "d_20240228", "d_20240229"]
    assert rows(got) == [(1, 0.0, 5.0), (2, 0.0, 0.0)]


# --- cleaning and profiles ---------------------------------------------------------------------


def test_infinities_and_modes(spark):
    df = spark.createDataFrame(
        [(1, float("inf"), "b"), (2, float("-inf"), "a"), (3, float("nan"), None), (4, None, "b"), (5, 1.5, "a")],
        "id int, v double, s string",
    )
    assert rows(clean.clean_inf(df, ["v"]).select("id", "v")) == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 1.5)]
    assert clean.clean_inf(df, ["v"], None).where("v is null").count() == 4
    # a and b are equally frequent.
    assert rows(clean.fill_mode(df, ["s"]).select("id", "s"))[2] == (3, "a")
    assert rows(clean.non_finite_columns(clean.range_report(df))) == [("v",)]


def test_narrowing(spark):
    schema = "b long, s double, i long, l long, f double, n double, g int"
    df = spark.createDataFrame(
        [(127, 300.0, -(2**31), 2**40, 0.5, None, 1), (-128, float("inf"), 5, 0, 70000.25, None, None)], schema
    )
    narrowed, report = clean.narrow_types(df)
    kinds = dict(narrowed.dtypes)
    assert kinds == {"b": "tinyint", "s": "smallint", "i": "int", "l": "bigint", "f": "float", "n": "double", "g": "tinyint"}
    assert rows(narrowed.select("b", "s", "g")) == [(-128, None, None), (127, 300, 1)]
    assert {r["column_name"]: r["non_finite_count"] for r in report.collect()} == {
        "b": 0, "s": 1, "i": 0, "l": 0, "f": 0, "n": 2, "g": 1,
    }


def test_fill_mean_ignores_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert sorted(r["a"] for r in clean.fill_mean(df).collect()) == [1.0, 2.0, 3.0]


def test_profiles_of_sparse_columns(spark):
    df = spark.createDataFrame([("x", None, 1.0), ("y", None, None), ("x", None, 4.0)], "s string, e string, v double")
    found = {r["column_name"]: r for r in profile.describe_categorical(df).collect()}
    assert (found["s"]["count"], found["s"]["unique"], found["s"]["top"], found["s"]["freq"]) == (3, 2, "x", 2)
    assert (found["e"]["count"], found["e"]["unique"], found["e"]["top"]) == (0, 0, None)
    assert profile.describe_numeric(df).first()["p50"] == 2.5
    assert [r["column_name"] for r in profile.summary_table(df).collect()] == ["v", "e", "s"]
    assert rows(profile.value_counts(df, "s"), F.desc("count")) == [("x", 2), ("y", 1)]


def test_reading_decimal_text(spark, tmp_path):
    header = ",".join(name for name, _ in ORDER_LINE_COLUMNS)
    text = {"customer_gender": "1.0", "member_id": "12.0", "order_pay_time": "2013-08-31 23:59:59", "goods_list_time": "none"}
    line = ",".join(text.get(name, "x" if kind == "string" else "3") for name, kind in ORDER_LINE_COLUMNS)
    (tmp_path / "lines.csv").write_text(f"{header}\n{line}\n")
    from repurchase.sources.transactions import read_transactions

    got = read_transactions(spark, str(tmp_path / "lines.csv")).first()
    assert (got["customer_gender"], got["member_id"], got["order_id"]) == (1, 12, 3)
    assert got["order_pay_time"] == datetime(2013, 8, 31, 23, 59, 59) and got["goods_list_time"] is None


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), float("nan"))], "goods_price double, customer_gender double")
    assert conform(df).first()[:] == (None, None)


# --- scaling, selection ------------------------------------------------------------------------


def test_scaling(spark):
    train = spark.createDataFrame([(0.0, 3.0), (10.0, 3.0)], "a double, c double")
    score = spark.createDataFrame([(5.0, 3.0), (20.0, 4.0)], "a double, c double")
    assert rows(minmax_scale(train, ["a", "c"])) == [(0.0, None), (1.0, None)]
    assert rows(minmax_scale(score, ["a"], fit_on=train).select("a")) == [(0.5,), (2.0,)]
    assert rows(minmax_scale(score, ["a"]).select("a")) == [(0.0,), (1.0,)]


def test_anova_and_information(spark):
    data = [(0, 1.0, 1.0, 7.0), (0, 2.0, 1.0, 7.0), (1, 3.0, 9.0, 7.0), (1, 5.0, 9.0, 7.0), (1, None, 9.0, 7.0)]
    df = spark.createDataFrame(data, "label int, x double, y double, constant double")
    scores = {r["feature"]: r["score"] for r in selection.anova_scores(df, ["x", "y", "constant"], "label").collect()}
    x = np.array([1, 2, 3, 5, 2.75])
    groups = [x[:2], x[2:]]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert scores["x"] == pytest.approx(between / (within / 3))
    assert scores["y"] is None and scores["constant"] is None
    found = {r["feature"]: r["score"] for r in selection.mutual_info(df, ["y", "constant"], "label", 4).collect()}
    entropy = -(0.4 * math.log(0.4) + 0.6 * math.log(0.6))
    assert found["y"] == pytest.approx(entropy) and found["constant"] == pytest.approx(0.0)


def test_weights_and_flags(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, 1.0), (3, 0, 1.0), (4, 1, 1.0)], "customer_id int, label int, x double")
    weighed = class_weights(df, "label").groupBy("label").agg(F.sum("weight").alias("w"))
    assert rows(weighed) == [(0, 2.0), (1, 2.0)]
    assert rows(with_null_flags(df, ["x"]).select("customer_id", "x_missing")) == [(1, 1), (2, 0), (3, 0), (4, 0)]


# --- decisions and metrics ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    # Scores tie across the cut.
    data = [(1, 0.9, 1), (2, 0.5, 0), (3, 0.5, 1), (4, 0.5, 0), (5, 0.1, 0), (6, 0.4, 1)]
    return spark.createDataFrame(data, "customer_id long, score double, label int")


def test_top_n_counts_exactly(scored):
    def marked(n, **more):
        return [c for c, r in rows(decisions.label_top_n(scored, "score", n, "customer_id", **more).select("customer_id", "result")) if r]

    assert marked(3) == [1, 2, 3] and marked(3, inclusive=True) == [1, 2, 3, 4]
    assert marked(0) == [] and marked(99) == [1, 2, 3, 4, 5, 6]


def test_thresholds_are_strict(scored):
    assert scored.transform(decisions.by_threshold, "score", 0.5).where("result = 1").count() == 1
    assert scored.transform(decisions.by_threshold, "score", 0.4).where("result = 1").count() == 4


def test_missing_scores_become_zero(spark, scored):
    template = spark.createDataFrame([(1, 0.0), (77, 0.0)], "customer_id long, result double")
    assert rows(decisions.attach_scores(template, scored)) == [(1, 0.9), (77, 0.0)]


def test_metrics(spark, scored):
    pairs = [(a, b) for _, a, la in rows(scored) if la for _, b, lb in rows(scored) if not lb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert metrics.roc_auc(scored, "label", "score").first()[0] == pytest.approx(auc)
    decided = decisions.by_threshold(scored, "score", 0.45)
    assert metrics.accuracy(decided, "label", "result").first()[0] == pytest.approx(3 / 6)
    assert metrics.balanced_accuracy(decided, "label", "result").first()[0] == pytest.approx((2 / 3 + 1 / 3) / 2)
    one_class = decided.where("label = 1")
    assert metrics.balanced_accuracy(one_class, "label", "result").first()[0] == pytest.approx(2 / 3)
    certain = spark.createDataFrame([(1, 0.0)], "label int, score double")
    assert metrics.log_loss(certain, "label", "score").first()[0] == pytest.approx(-math.log(1e-15))
    sweep = decisions.topn_sweep(scored, "score", "label", [1, 3], "customer_id")
    assert [r[1] for r in rows(sweep)] == pytest.approx([(1 / 3 + 1) / 2, (2 / 3 + 2 / 3) / 2])


def test_histogram_is_numpys(spark, scored):
    for values in ([0.1, 0.2, 0.2, 0.7, 1.1], [3.0, 3.0]):
        df = spark.createDataFrame([(v,) for v in values], "score double")
        counts, edges = np.histogram(values, bins=5)
        got = rows(metrics.histogram(df, "score", 5), "bin")
        assert [r[3] for r in got] == list(counts)
        assert [r[1] for r in got] + [got[-1][2]] == pytest.approx(list(edges))


# --- clusters ----------------------------------------------------------------------------------


def test_empty_cluster_ties_and_unknown(spark):
    data = [(1, [0.0, 0.0], 2), (2, [0.0, 1.0], 1), (3, [9.0, 9.0], 3)]
    df = spark.createDataFrame(data, "customer_id long, features array<double>, label int")
    centers = [(0, [0.0, 0.0]), (1, [10.0, 10.0]), (2, [10.0, 10.0])]
    centroids = spark.createDataFrame(centers, "cluster int, center array<double>")
    assigned = clusters.assign(df, centroids)
    # The first of two equal centers wins.
    assert rows(assigned.select("customer_id", "cluster")) == [(1, 0), (2, 0), (3, 1)]
    moved = rows(clusters.update(assigned, centroids))
    assert moved == [(0, [0.0, 0.5]), (1, [9.0, 9.0]), (2, [10.0, 10.0])]
    named = clusters.cluster_labels(assigned, centroids)
    assert rows(named) == [(0, 1), (1, 3), (2, -1)]
    far = spark.createDataFrame([(4, [0.0, 0.2])], "customer_id long, features array<double>")
    assert clusters.kmeans_predict(far, centroids, named.where("cluster > 0")).first()["prediction"] == -1


def test_points_must_fit_the_model(spark):
    df = spark.createDataFrame([(1, [0.0])], "customer_id long, features array<double>")
    centroids = spark.createDataFrame([(0, [0.0, 0.0])], "cluster int, center array<double>")
    with pytest.raises(Exception, match="arrays of 2 numbers"):
        clusters.assign(df, centroids).collect()


def test_splits_keep_rows_without_key_or_label(spark):
    df = spark.createDataFrame([(1, 0), (None, 1), (3, None), (4, None), (5, 0)], "id int, y int")
    first, last = splits.ordered_split(df, "id", 0.5)
    assert rows(first, "id") == [(None, 1), (1, 0)] and last.count() == 3
    only = spark.createDataFrame([(1,), (None,), (3,)], "id int")
    first, last = splits.ordered_split(only, "id", 0.5)
    assert rows(first) == [(None,)] and rows(last) == [(1,), (3,)]
    keyed = df.where("id is not null")
    for exact in (True, False):
        train, held = splits.stratified_split(keyed, "y", 0.5, 1, "id", exact)
        assert train.count() + held.count() == 4
    assert held.columns == ["id", "y"]
    train, held = splits.stratified_split(keyed, "y", 0.5, 1, "id")
    assert held.where("y is null").count() == 1 and held.where("y = 0").count() == 1


def test_null_is_a_group_of_running_totals_and_a_class_of_weights(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, v int")
    got = running_totals(df, {"upto": F.col("v")}, [F.col("v")], ["g"])
    assert sorted((r.g or "", r.upto) for r in got.collect()) == [("", 2), ("", 5), ("a", 1)]
    weights = class_weights(df, "g").collect()
    assert sorted((r.g or "", r.weight) for r in weights) == [("", 0.75), ("", 0.75), ("a", 1.5)]


def test_missing_decisions_are_wrong(spark):
    df = spark.createDataFrame([(1, None), (1, 1), (0, 0), (None, 1)], "y int, d int")
    assert metrics.accuracy(df, "y", "d").first()[0] == pytest.approx(2 / 3)
    assert metrics.balanced_accuracy(df, "y", "d").first()[0] == 0.75


def test_histogram_without_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert rows(metrics.histogram(df, "v", 2), "bin") == [(0, 0.0, 0.5, 0), (1, 0.5, 1.0, 0)]


def test_large_values(spark):
    df = spark.createDataFrame([(1e300, 2.0**63, 8e14), (1.5, 1.0, None), (None, None, 8e14)], "f double, w double, m double")
    narrowed, _ = clean.narrow_types(df, ["f", "w"])
    assert narrowed.agg(F.max("f"), F.max(F.col("w").cast("double"))).first() == (1e300, 2.0**63)
    many = spark.range(20_000).select(F.lit(8e14).alias("m"))
    assert clean.fill_mean(many, ["m"], decimals=4).agg(F.max("m")).first()[0] == pytest.approx(8e14)


def test_modes_of_several_types(spark):
    df = spark.createDataFrame([("b", 10, 1.5), ("a", 9, None), (None, None, None)], "s string, i int, d double")
    assert clean.fill_mode(df, ["s", "i", "d"]).where("s = 'a' and i = 9 and d = 1.5").count() == 2


def test_deviation_of_large_values(spark):
    df = spark.createDataFrame([(i, 1e8 + 0.01 * i) for i in (1, 2, 3)], "age int, v double")
    got = df.agg(DayWindow(F.col("v"), F.col("age"), 3).std()).first()[0]
    assert got == pytest.approx(0.01, rel=1e-5)


def test_information_by_quantiles_of_sparse_columns(spark):
    df = spark.createDataFrame([(float(i), None, i % 2) for i in range(20)] + [(1e9, 5.0, None)], "a double, b double, y int")
    got = {r.feature: r.score for r in selection.mutual_info(df, ["a", "b"], "y", 4, "quantile").collect()}
    assert got["b"] == pytest.approx(0.0) and got["a"] < 0.1


def test_rejected_lines_name_their_first_bad_cell(spark, tmp_path):
    header = ",".join(name for name, _ in ORDER_LINE_COLUMNS)
    plain = {"long": "1", "int": "1.0", "double": "2.5", "string": "x y", "timestamp_ntz": "2024-01-01 10:00:00"}

    def line(**cells):
        return ",".join(cells.get(name, plain[kind]) for name, kind in ORDER_LINE_COLUMNS)

    lines = {
        "good": line(), "empty cells": line(goods_price="", customer_gender="", order_pay_time=""), "quoted": line(customer_city='"a, b"'),
        "bad time": line(order_pay_time="yesterday", goods_id="abc"), "bad id": line(goods_id="abc"), "too large": line(order_status="3e9"),
        "short": "1,2,3", "long": line() + ",more", "other header": header.replace("goods_id", "goods"), "not a number": line(goods_price="NaN"),
    }
    for i, part in enumerate((list(lines.values())[:6], list(lines.values())[6:], [])):
        (tmp_path / f"part{i}.csv").write_text("\n".join([header, *part, ""]))
    good, rejects = split_transactions(spark, str(tmp_path))
    assert [n for n, _ in good.dtypes] == [n for n, _ in ORDER_LINE_COLUMNS] and [k for _, k in read_transactions(spark, str(tmp_path)).dtypes] == [k for _, k in good.dtypes]
    assert sorted(r.customer_city for r in good.collect()) == ["a, b", "x y", "x y", "x y"]
    assert good.where("goods_price is null").count() == 2
    got = {r.line: (r.column_name, r.text, r.file.rpartition("/")[2]) for r in rejects.collect()}
    assert got == {
        lines["bad time"]: ("order_pay_time", "yesterday", "part0.csv"), lines["bad id"]: ("goods_id", "abc", "part0.csv"),
        lines["too large"]: ("order_status", "3e9", "part0.csv"), lines["short"]: (None, None, "part1.csv"),
        lines["long"]: (None, None, "part1.csv"), lines["other header"]: ("order_detail_id", "order_detail_id", "part1.csv"),
    }
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.csv").write_text(header + "\n")
    assert [df.count() for df in split_transactions(spark, str(empty))] == [0, 0]


def test_submission_as_one_file(spark, tmp_path):
    df = spark.createDataFrame([(i * 7 % 50, i % 2) for i in range(50)], "customer_id long, result int").repartition(5)
    write_submission(df, str(tmp_path / "one"), single_file=True)
    (part,) = (tmp_path / "one").glob("*.csv")
    assert part.read_text().split() == ["customer_id,result"] + [f"{i},{r}" for i, r in sorted((i * 7 % 50, i % 2) for i in range(50))]
