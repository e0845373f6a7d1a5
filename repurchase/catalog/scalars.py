"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from repurchase.catalog.fixtures import TX, order_lines, table
from repurchase.catalog.registry import query
from repurchase.catalog.tables import RATIO_SOURCE, ratios
from repurchase.functions import expressions as X


@query(
    "x1_null_tests",
    f"with {TX} select order_id, count(*) filter (where goods_price is null) as missing, count(*) filter (where goods_price"
    " is not null) as present, bool_or(goods_price is null) as any_missing from tx group by 1",
)
def _(spark, sf_dir):
    price = F.col("goods_price")
    return order_lines(spark, sf_dir, "order_id", "goods_price").groupBy("order_id").agg(
        F.count(F.when(price.isNull(), 1)).alias("missing"),
        F.count(F.when(price.isNotNull(), 1)).alias("present"),
        X.any_null(price).alias("any_missing"),
    )


@query(
    "x2_finite",
    "select l_orderkey, l_linenumber, l_partkey, l_quantity, ratio is not null and isfinite(ratio) as is_finite"
    f" from {RATIO_SOURCE}",
)
def _(spark, sf_dir):
    return ratios(spark, sf_dir).withColumn("is_finite", X.finite("ratio")).drop("ratio")


@query(
    "x3_whole_numbers",
    "select l_orderkey, l_linenumber, l_partkey, cast(trunc(l_extendedprice) as bigint) as units,"
    " round(abs(l_extendedprice - trunc(l_extendedprice)), 4) as rest from lineitem",
)
def _(spark, sf_dir):
    units = X.whole("l_extendedprice")
    rest = F.round(F.abs(F.col("l_extendedprice") - units), 4)
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", units.alias("units"), rest.alias("rest"))


@query(
    "x4_decay_weight",
    "select event_id, round(pow(0.9::double, date_diff('day', cast(ts as date), date '2024-01-31') - 1), 9) as weight from events",
)
def _(spark, sf_dir):
    age = F.datediff(X.as_date("2024-01-31"), F.to_date("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.pow(F.lit(0.9), age - 1), 9).alias("weight"))


@query("x5_flag", "select event_id, case when event_type = 'purchase' then 1 else 0 end as bought from events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.flag(F.col("event_type") == "purchase").alias("bought"))


@query(
    "x6_calendar",
    "select user_id, unnest(generate_series(min(ts)::date, min(ts)::date + 6, interval 1 day))::date as day from events group by 1",
)
def _(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first"))
    return first.select("user_id", F.explode(X.calendar_from(F.col("first"), 7)).alias("day"))


@query(
    "x7_epoch_days",
    "select event_id, date_diff('day', date '2024-01-10', cast(ts as date))::int as days from events",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.days_since("2024-01-10", "ts").alias("days"))


@query("x10_one_if_positive", "select c_custkey, case when c_acctbal > 0 then 1.0::double else c_acctbal end as capped from customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.one_if_positive("c_acctbal").alias("capped"))
