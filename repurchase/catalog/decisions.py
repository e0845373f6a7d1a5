"""Decisions and metrics on a score that needs no training: recency-weighted purchases of each user."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import DENSE, DENSE_UNTIL, order_lines, SINCE_UNTIL, START
from repurchase.catalog.registry import query
from repurchase.catalog.rolling import COLUMNS, EVENT_DAILY, ORDER_DAILY, WindowSql, event_daily
from repurchase.catalog.labels import horizon_sql
from repurchase.catalog.tables import template
from repurchase.operators import decisions as D
from repurchase.operators import metrics as M
from repurchase.operators.ranking import top_n
from repurchase.operators.rolling import rolling_features
from repurchase.plans.forecast import repeat_buyer_ranking

SPEC = replace(DENSE, extra=("decay_sum",))


def scored(spark, sf_dir) -> DataFrame:
    """customer_id, score in [0, 1) with many ties, label."""
    features = rolling_features(event_daily(spark, sf_dir), DENSE_UNTIL, SPEC, label=True)
    weight = F.col("goods_decay_sum_14")
    return features.select("customer_id", F.round(weight / (weight + 1), 6).alias("score"), "label")


_WEIGHT = WindowSql("day_num", DENSE_UNTIL, 14).decay_sum()
SCORED = (
    f"{EVENT_DAILY}, weighted as (select customer_id, {_WEIGHT} as w, {horizon_sql(DENSE_UNTIL, 1)} from daily"
    f" group by 1 having min(day) < date '{DENSE_UNTIL}'),"
    " scored as (select customer_id, round(w / (w + 1), 6) as score, label from weighted),"
    " ranked as (select *, row_number() over (order by score desc, customer_id) as position from scored)"
)


@query("m0_score", f"{SCORED} select * from scored")
def _(spark, sf_dir):
    return scored(spark, sf_dir)


@query(
    "j1_attach",
    f"{SCORED} select c_custkey as customer_id, coalesce(score, 0.0) as score from customer left join scored on c_custkey ="
    " customer_id",
)
def _(spark, sf_dir):
    return D.attach_scores(template(spark, sf_dir), scored(spark, sf_dir))


@query("f8_top_n", f"{SCORED} select customer_id, score, label from ranked where position <= 25")
def _(spark, sf_dir):
    return top_n(scored(spark, sf_dir), "score", 25, "customer_id")


def threshold(t: float):
    def run(spark, sf_dir):
        return D.by_threshold(scored(spark, sf_dir), "score", t)

    return run


for _key, _t in (("m1_threshold_low", 0.1), ("m2_threshold_mid", 0.4), ("m3_threshold_half", 0.5)):
    query(_key, f"{SCORED} select *, case when score > {_t} then 1 else 0 end as result from scored")(threshold(_t))

SWEEP = (5, 10, 20, 40, 60, 80, 100, 120)


@query(
    "m4_topn_sweep",
    f"{SCORED} select n::bigint as n, (count(*) filter (where label = 1 and position <= n)::double / count(*) filter"
    " (where label = 1) + count(*) filter (where label = 0 and position > n)::double / count(*) filter (where label = 0))"
    f" / 2 as balanced_accuracy from ranked cross join unnest([{', '.join(map(str, SWEEP))}]) as s(n) group by n",
)
def topn_sweep(spark, sf_dir):
    return D.topn_sweep(scored(spark, sf_dir), "score", "label", SWEEP, "customer_id")


@query("m5_label_top_n", f"{SCORED} select customer_id, score, label, (position <= 60)::int as result from ranked")
def label_top_n(spark, sf_dir):
    return D.label_top_n(scored(spark, sf_dir), "score", 60, "customer_id")


@query("m5_label_top_n_inclusive", f"{SCORED} select customer_id, score, label, (position <= 61)::int as result from ranked")
def _(spark, sf_dir):
    return D.label_top_n(scored(spark, sf_dir), "score", 60, "customer_id", inclusive=True)


DECIDED = f"{SCORED}, decided as (select *, case when score > 0.4 then 1 else 0 end as result from scored)"


@query(
    "m6_balanced_accuracy",
    f"{DECIDED}, recalls as (select label, avg((label = result)::int) as recall from decided group by 1)"
    " select avg(recall) as balanced_accuracy from recalls",
)
def _(spark, sf_dir):
    return M.balanced_accuracy(threshold(0.4)(spark, sf_dir), "label", "result")


@query("m7_accuracy", f"{DECIDED} select avg((label = result)::int) as accuracy from decided")
def _(spark, sf_dir):
    return M.accuracy(threshold(0.4)(spark, sf_dir), "label", "result")


@query(
    "m8_auc",
    f"{SCORED}, counted as (select score, count(*) filter (where label = 1) as ones, count(*) filter (where label = 0) as"
    " zeros from scored group by 1), ordered as (select *, sum(zeros) over (order by score) as upto from counted)"
    " select sum(ones * (2 * upto - zeros))::double / (sum(ones)::double * sum(zeros)::double * 2.0::double) as auc from ordered",
)
def _(spark, sf_dir):
    return M.roc_auc(scored(spark, sf_dir), "label", "score")


@query(
    "m9_log_loss",
    f"{SCORED}, clipped as (select label, least(greatest(score, 1e-15::double), 1.0::double - 1e-15::double) as p from scored)"
    " select round(-avg(label * ln(p) + (1 - label) * ln(1.0::double - p)), 6) as log_loss from clipped",
)
def _(spark, sf_dir):
    return M.log_loss(scored(spark, sf_dir), "label", "score").select(F.round("log_loss", 6).alias("log_loss"))


@query(
    "m10_histogram",
    f"{SCORED}, ends as (select min(score) as low, max(score) as high from scored), placed as (select"
    " (select count(*) from range(1, 50) as e(b) where score >= low + b * ((high - low) / 50)) as bin from scored, ends)"
    " select b::int as bin, round(low + b * ((high - low) / 50), 6) as low, round(low + (b + 1) * ((high - low) / 50), 6)"
    " as high, (select count(*) from placed where bin = b) as count from ends, range(50) as r(b)",
)
def _(spark, sf_dir):
    counted = M.histogram(scored(spark, sf_dir), "score", 50)
    return counted.withColumns({c: F.round(c, 6) for c in ("low", "high")})


_SPENT = WindowSql("day_payment", SINCE_UNTIL, 91)


@query(
    "repeat_buyer_ranking",
    f"{ORDER_DAILY}, ranked as (select customer_id, round({_SPENT.decay_sum()}, 4) as score, round({_SPENT.sum()}, 4) as"
    f" spent, {_SPENT.last()} as days_since_last, {horizon_sql(SINCE_UNTIL, 30)} from daily group by 1 having min(day) <"
    f" date '{SINCE_UNTIL}') select *, (row_number() over (order by score desc, customer_id) <= 300)::int as chosen from ranked",
)
def ranking(spark, sf_dir):
    return repeat_buyer_ranking(order_lines(spark, sf_dir, *COLUMNS), START, SINCE_UNTIL, 91, 30, 300)
