"""Cutoffs, labels, data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from repurchase.catalog.fixtures import (
    DENSE, DENSE_START, DENSE_UNTIL, EVENT_TX, ROLLING, SINCE_UNTIL, SNAPSHOT, START, TX, UNTIL, daily_sql,
    event_lines, order_lines, order_spans, table,
)
from repurchase.catalog.registry import query
from repurchase.catalog.snapshot import round_std, snapshot_sql
from repurchase.operators import labels as L
from repurchase.operators.rolling import daily_sums
from repurchase.plans.dataset import build_dataset

LINE = ("customer_id", "order_id", "line_number", "goods_id", "order_pay_time")
LATER = "2001-07-31 23:59:59"


def some_lines(spark, sf_dir):
    return order_lines(spark, sf_dir, *LINE)


@query("f1_history", f"with {TX} select {', '.join(LINE)} from tx where order_pay_time <= timestamp '{UNTIL}'")
def _(spark, sf_dir):
    return L.history(some_lines(spark, sf_dir), UNTIL)


@query("f2_since", f"with {TX} select {', '.join(LINE)} from tx where cast(order_pay_time as date) > date '{START}'")
def _(spark, sf_dir):
    return L.since(some_lines(spark, sf_dir), START)


@query("f3_future", f"with {TX} select {', '.join(LINE)} from tx where order_pay_time > timestamp '{UNTIL}'")
def _(spark, sf_dir):
    return L.future(some_lines(spark, sf_dir), UNTIL)


@query(
    "f4_buyers",
    f"with {TX} select distinct member_id from tx where order_pay_time > timestamp '{UNTIL}' and member_id is not null",
)
def _(spark, sf_dir):
    return L.buyers(L.future(order_lines(spark, sf_dir, "member_id", "order_pay_time"), UNTIL), "member_id")


@query(
    "f5_split_label",
    "select doc_id, quality, case when quality is null then 'score' else 'train' end as part"
    " from documents left join labels using (doc_id)",
)
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    joined = documents.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    train, score = L.split_by_label(joined, "quality")
    return train.withColumn("part", F.lit("train")).unionByName(score.withColumn("part", F.lit("score")))


@query(
    "j2_membership",
    f"with {TX} select c_custkey, case when c_custkey in (select customer_id from tx where order_pay_time >"
    f" timestamp '{UNTIL}') then 1 else 0 end as bought from customer",
)
def _(spark, sf_dir):
    tx = order_lines(spark, sf_dir, "customer_id", "order_pay_time")
    members = L.buyers(L.future(tx, UNTIL)).withColumnRenamed("customer_id", "c_custkey")
    return L.with_membership(table(spark, sf_dir, "customer").select("c_custkey"), members, "c_custkey", "bought")


LABEL_FUTURE = (
    f"labelled as (select customer_id, max(case when order_pay_time > timestamp '{UNTIL}' then 1 else 0 end) as label"
    f" from tx group by 1 having min(order_pay_time) <= timestamp '{UNTIL}')"
)


@query("l1_label_future", f"with {TX}, {LABEL_FUTURE} select * from labelled")
def label_future(spark, sf_dir):
    return L.label_future(order_lines(spark, sf_dir, "customer_id", "order_pay_time"), UNTIL)


def horizon_sql(until: str, days: int) -> str:
    inside = f"day between date '{until}' and date '{until}' + {days - 1}"
    return f"case when coalesce(max(day_num) filter (where {inside}), 0) > 0 then 1 else 0 end as label"


@query(
    "l2_label_horizon",
    f"with {TX}, {daily_sql(START)} select customer_id, {horizon_sql(SINCE_UNTIL, 30)} from daily group by 1",
)
def _(spark, sf_dir):
    columns = ("customer_id", "order_pay_time", "order_total_payment", "order_total_num")
    return L.label_horizon(daily_sums(order_lines(spark, sf_dir, *columns), START), SINCE_UNTIL, ROLLING.horizon)


@query(
    "l2_label_next_day",
    f"with {EVENT_TX}, {daily_sql(DENSE_START)} select customer_id, {horizon_sql(DENSE_UNTIL, 1)} from daily group by 1",
)
def _(spark, sf_dir):
    return L.label_horizon(daily_sums(event_lines(spark, sf_dir), DENSE_START), DENSE_UNTIL, DENSE.horizon)


TRAIN_SQL = (
    f"{snapshot_sql(UNTIL)}, train as (select *, case when customer_id in (select customer_id from tx where"
    f" order_pay_time > timestamp '{UNTIL}') then 1 else 0 end as label from snapshot)"
)


@query("l3_train_set", f"with {TX}, {TRAIN_SQL} select * from train")
def train_set(spark, sf_dir):
    return round_std(build_dataset(order_lines(spark, sf_dir), UNTIL, True, spec=SNAPSHOT, known=order_spans(spark, sf_dir)))


@query("l3_score_set", f"with {TX}, {snapshot_sql(LATER)} select * from snapshot")
def score_set(spark, sf_dir):
    return round_std(build_dataset(order_lines(spark, sf_dir), LATER, False, spec=SNAPSHOT, known=order_spans(spark, sf_dir)))


@query(
    "u1_stack",
    f"with {TX}, {TRAIN_SQL}, later as (select customer_id, max(order_pay_time) as latest from tx where order_pay_time"
    f" <= timestamp '{LATER}' group by 1) select customer_id, order_count, label, null::timestamp as latest from train"
    " union all select customer_id, null, null, latest from later",
)
def _(spark, sf_dir):
    train = train_set(spark, sf_dir).select("customer_id", "order_count", "label")
    seen = L.history(order_lines(spark, sf_dir, "customer_id", "order_pay_time"), LATER)
    return L.stack(train, seen.groupBy("customer_id").agg(F.max("order_pay_time").alias("latest")))
