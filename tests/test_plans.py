"""Physical plans: shuffles, pushdown, and nothing customer-sized in a single task."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from repurchase.catalog import load, models
from repurchase.catalog import snapshot as months_catalog
from repurchase.catalog.fixtures import SNAPSHOT, START, UNTIL, event_lines, order_lines, table
from repurchase.functions.ordering import spans
from repurchase.operators.clean import fill_mean, known_report, narrow_types, range_report
from repurchase.operators import snapshot
from repurchase.operators.labels import history, label_future, since
from repurchase.operators.months import month_state, save_state, snapshot_from_months
from repurchase.operators.profile import null_counts
from repurchase.operators.rolling import daily_sums, rolling_features
from repurchase.operators.scaling import minmax_scale
from repurchase.operators.snapshot import snapshot_features
from repurchase.operators.splits import stratified_split
from repurchase.operators.training import class_weights
from repurchase.plans.dataset import snapshot_dataset
from repurchase.schema import ORDER_LINE_COLUMNS, SnapshotSpec
from repurchase.sources.storage import load_features, load_statistics, open_buckets, save_buckets, save_features
from repurchase.sources.transactions import read_transactions, save_transactions, split_transactions

SF_DIR = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (\w+)", plan(df))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Order lines as one stored table, so that only the operators' own shuffles show."""
    path = str(tmp_path_factory.mktemp("lines") / "tx")
    columns = order_lines(spark, SF_DIR).drop("line_number", "supplier_id")
    columns = columns.withColumn("order_detail_id", F.xxhash64("order_id", "goods_id", "order_detail_amount"))
    save_transactions(columns, path)
    return read_transactions(spark, path, "parquet")


def test_snapshot_needs_one_shuffle(stored):
    assert exchanges(snapshot_features(stored, UNTIL)) == ["hashpartitioning"]


def test_snapshot_runs_as_hash_aggregates(spark, stored):
    for features in (snapshot_features(stored, UNTIL), load()["snapshot_all"].run(spark, SF_DIR), load()["l3_train_set"].run(spark, SF_DIR)):
        text = plan(features)
        assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_months_before_the_cutoff_come_from_the_state(spark, stored, tmp_path):
    known = spans(stored, SnapshotSpec().order)
    save_state(month_state(stored, known=known), str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    features = snapshot_from_months(state, stored, "2001-03-14 12:00:00", known=known)
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(features))
    assert len(scans) == 2
    assert any(re.search(r"pay_month#\d+ < 200103", s) for s in scans) and any(re.search(r"pay_month#\d+ = 200103", s) for s in scans)
    # Replacing one month leaves the others.
    months = state.select("pay_month").distinct().count()
    save_state(month_state(stored.where("pay_month = 200101"), known=known).limit(3), str(tmp_path / "state"), "overwrite")
    again = spark.read.parquet(str(tmp_path / "state"))
    assert again.select("pay_month").distinct().count() == months and again.where("pay_month = 200101").count() == 3


def test_label_join_reuses_the_partitioning_of_the_features(stored):
    found = exchanges(snapshot_dataset(stored, UNTIL, True))
    # Features by customer, later buyers by customer; none for the join itself.
    assert found == ["hashpartitioning", "hashpartitioning"]


def test_label_needs_one_shuffle(stored):
    assert exchanges(label_future(stored, UNTIL)) == ["hashpartitioning"]


def test_rolling_combines_before_each_shuffle(stored):
    features = rolling_features(daily_sums(stored, START), "2001-07-02")
    assert exchanges(features) == ["hashpartitioning", "hashpartitioning"]
    assert plan(features).count("partial_sum") >= 2


def test_cutoffs_reach_the_scan(stored):
    text = plan(history(stored, UNTIL).select("customer_id"))
    assert "PushedFilters: [IsNotNull(order_pay_time), LessThanOrEqual(order_pay_time" in text
    assert re.search(r"PartitionFilters: \[isnotnull\(pay_month#\d+\), \(pay_month#\d+ <= 200105\)\]", text)
    assert re.search(r"ReadSchema: struct<order_pay_time:timestamp_ntz,customer_id:bigint>", text)
    assert "GreaterThanOrEqual(order_pay_time" in plan(since(stored, START))


def test_aggregates_of_numbers_are_hashed(spark):
    daily = daily_sums(event_lines(spark, SF_DIR), "2023-12-31")
    text = plan(rolling_features(daily, "2024-01-22"))
    assert "HashAggregate" in text and "SortAggregate" not in text


# Queries whose single-task steps see one row per column, class, bin, cluster or slice only.
RANKED = ("m4_topn_sweep", "m5_label_top_n", "m8_auc", "t1_stratified", "t2_ordered")


@pytest.mark.parametrize("name", RANKED)
def test_no_window_over_everything(spark, name):
    text = plan(load()[name].run(spark, SF_DIR))
    for window in re.findall(r"Window \[.*", text):
        # Unpartitioned windows would print an empty list of keys.
        assert ", [], [" not in window and not window.endswith(", []")


@pytest.mark.parametrize("name", (*RANKED, "p2_describe_numeric", "p5_summary_table", "repeat_buyer_ranking"))
def test_nothing_is_range_sorted_but_small_reports(spark, name):
    text = plan(load()[name].run(spark, SF_DIR))
    # A summary table is shown in order: one row per column.
    assert text.count("rangepartitioning") == (name == "p5_summary_table")
    # A checkpoint would show; the one row of quantiles per column does in the profiles.
    assert "ExistingRDD" not in text or name.startswith("p")


@pytest.mark.parametrize("name", ("m8_auc", "t1_stratified"))
def test_building_the_query_starts_no_job(spark, name):
    context = spark.sparkContext
    context.setJobGroup(f"building {name}", "")
    load()[name].run(spark, SF_DIR)
    jobs = len(context.statusTracker().getJobIdsForGroup(f"building {name}"))
    context.setJobGroup(f"opening {name}", "")
    table(spark, SF_DIR, "events" if name == "m8_auc" else "customer")
    opened = len(context.statusTracker().getJobIdsForGroup(f"opening {name}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2 * opened


def test_customers_are_read_only_when_needed(spark):
    assert "customer" not in plan(order_lines(spark, SF_DIR, "customer_id", "order_pay_time")).replace("customer_id", "")
    assert "lineitem" not in plan(table(spark, SF_DIR, "orders"))
    assert SNAPSHOT.money_decimals == 4


def test_bucketed_tables_join_and_group_without_exchange(spark, stored, tmp_path):
    features = save_buckets(snapshot_features(stored, UNTIL), "plan_features", str(tmp_path / "features"), 6)
    labels = save_buckets(label_future(stored, UNTIL), "plan_labels", str(tmp_path / "labels"), 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = features.join(labels, "customer_id")
        assert exchanges(joined) == [] and exchanges(joined.groupBy("customer_id").agg(F.max("label"))) == []
        spark.sql("drop table plan_labels")
        again = open_buckets(spark, "plan_labels_again", str(tmp_path / "labels"), 6)
        assert exchanges(features.join(again, "customer_id")) == []
        assert features.join(again, "customer_id").count() == labels_count(stored)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("plan_features", "plan_labels", "plan_labels_again"):
            spark.sql(f"drop table if exists {name}")


def labels_count(tx) -> int:
    return label_future(tx, UNTIL).count()


def test_stored_statistics_spare_the_scan(spark, tmp_path):
    path = str(tmp_path / "table")
    lines = table(spark, SF_DIR, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_shipdate", "l_returnflag")
    lines = lines.withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    save_features(lines, path, measure=True)
    known, df = load_statistics(spark, path), load_features(spark, path)
    assert df.columns == lines.columns and df.count() == lines.count() == known.rows
    context = spark.sparkContext
    context.setJobGroup("known", "")
    scaled = minmax_scale(df, ["l_quantity", "l_tax"], known=known)
    filled, (narrow, _) = fill_mean(df, ["l_tax"], known=known), narrow_types(df, ["l_orderkey", "l_quantity"], known)
    jobs = len(context.statusTracker().getJobIdsForGroup("known"))
    context.setLocalProperty("spark.jobGroup.id", None)
    # Only the report's few rows are read, which takes no scan of the table.
    assert jobs <= 1
    for got, want in (
        (scaled, minmax_scale(df, ["l_quantity", "l_tax"])), (narrow, narrow_types(df, ["l_orderkey", "l_quantity"])[0]),
        (known_report(df, known), range_report(df)), (null_counts(df, known=known), null_counts(df)),
    ):
        assert got.dtypes == want.dtypes and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert filled.where("l_tax is null").count() == 0
    assert known.span("l_shipdate") == df.agg(F.min("l_shipdate"), F.max("l_shipdate")).first()[:]
    # A file added later makes them void.
    lines.limit(1).write.mode("append").parquet(path)
    assert load_statistics(spark, path) is None
    save_features(lines, str(tmp_path / "plain"))
    assert load_statistics(spark, str(tmp_path / "plain")) is None


def test_lines_are_parsed_once(spark, tmp_path):
    """A filter that repeats the parser at every mention of a cell takes minutes per million lines."""
    (tmp_path / "lines.csv").write_text("1,2\n")
    for part in split_transactions(spark, str(tmp_path)):
        text = part._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("from_csv(") == 1
        assert text.count("try_cast(cells") <= len(ORDER_LINE_COLUMNS)


def test_lines_meet_parts_while_they_are_narrow(spark):
    text = order_lines(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" in next(line for line in text.splitlines() if "Join " in line)


def test_lines_as_text_are_packed(spark):
    for name in ("s1_read_csv", "s1_good_lines"):
        files = load()[name].run(spark, "/root/testdata/sf0.001").inputFiles()
        assert files and all(f.endswith(".lz4") for f in files)


def test_snapshot_tables_join_lines_once(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(models, "order_lines", lambda *args: joined.append(args) or order_lines(*args))
    monkeypatch.setattr(snapshot, "spans", lambda *args: pytest.fail("measured on joined lines"))
    for df in models.snapshot_tables(spark, "/root/testdata/sf0.001"):
        assert "Join" not in plan(df)
    assert len(joined) == 1


@pytest.mark.parametrize("name", ["snapshot_from_months", "snapshot_from_months_mid"])
def test_lines_of_an_order_stay_together_in_their_state(spark, monkeypatch, name):
    """Lines are dealt out by order last, so that partial state rows combine the lines of an order."""
    seen = []
    save = months_catalog.save_transactions
    monkeypatch.setattr(months_catalog, "save_transactions", lambda tx, path: seen.append(tx) or save(tx, path))
    load()[name].run(spark, "/root/testdata/sf0.001")
    text = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" in next(line for line in text.splitlines() if "Join " in line)


@pytest.mark.parametrize("save", [save_transactions, save_state])
def test_lines_and_states_are_written_where_they_are(spark, tmp_path, save):
    """Three tasks write a file of the month each; dealt out by month, one task would write them all."""
    rows = spark.range(0, 300, numPartitions=3).selectExpr(
        "id as customer_id", "timestamp_ntz '2001-01-05 10:00:00' as order_pay_time", "200101L as pay_month"
    )
    save(rows if save is save_state else rows.drop("pay_month"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "pay_month=200101").glob("*.parquet"))) == 3
    assert spark.read.parquet(str(tmp_path / "out")).select("customer_id").distinct().count() == 300


def test_rows_of_a_class_are_trained_on_where_they_are(spark):
    """Weights and split come to the rows: joined by class, all rows of a class would be one task of every round."""
    rows = spark.range(0, 2100, numPartitions=7).selectExpr("id as customer_id", "cast(nullif(id % 3, 2) as int) as label")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in stratified_split(class_weights(rows, "label"), "label", 0.2, 42, "customer_id"):
            held = [r["count"] for r in part.groupBy(F.spark_partition_id(), "label").count().collect()]
            assert len(held) == 21 and max(held) < 3 * min(held)
            assert {(r.label, round(r.weight, 9)) for r in part.select("label", "weight").distinct().collect()} == {(0, 1.0), (1, 1.0), (None, 1.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
