"""Snapshot features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.catalog.fixtures import (
    EVENT_TX, ORDER, SNAPSHOT, SNAPSHOT_RATIO, TX, UNTIL, cents, event_lines, order_lines, order_spans,
)
from repurchase.catalog.registry import query
from repurchase.functions import expressions as X
from repurchase.operators import snapshot as S
from repurchase.operators.labels import history
from repurchase.operators.months import month_state, save_state, snapshot_from_months
from repurchase.runtime import scratch_path
from repurchase.sources.transactions import save_transactions

ROW = f"row({', '.join(ORDER)})"
SEEN = f"from tx where order_pay_time <= timestamp '{UNTIL}' group by customer_id"


def last_sql(c: str) -> str:
    return f"arg_max({c}, {ROW}) filter (where {c} is not null)"


def lasts_sql(columns) -> list[str]:
    return [f"{last_sql(c)} as {c}_last" for c in columns]


def money_mean_sql(c: str) -> str:
    return f"{cents(c)} / nullif(count({c}), 0)"


def spread_sql(c: str) -> list[str]:
    return [
        f"{money_mean_sql(c)} as {c}_mean",
        f"round(stddev_samp({c}), 4) as {c}_std",
        f"max({c}) as {c}_max",
        f"min({c}) + 0.0::double as {c}_min",
    ]


def level_sql(c: str, prefix: str, money: bool) -> list[str]:
    if money:
        return [f"{money_mean_sql(c)} as {prefix}_mean", f"{cents(c)} as {prefix}_sum"]
    return [
        f"avg({c}) as {prefix}_mean",
        f"coalesce(sum(cast({c} as double)), 0.0::double) as {prefix}_sum",
    ]


def round_std(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in df.columns if c.endswith("_std")})


def per_customer(columns: list[str]) -> str:
    return f"with {TX} select customer_id, {', '.join(columns)} {SEEN}"


def lines(spark, sf_dir, *columns: str) -> DataFrame:
    wanted = dict.fromkeys(("customer_id", *ORDER, *columns))
    return history(order_lines(spark, sf_dir, *wanted), UNTIL)


def lasts(columns):
    def run(spark, sf_dir):
        tx = S.with_order(lines(spark, sf_dir, *columns), SNAPSHOT, order_spans(spark, sf_dir))
        return S.aggregate_by_customer(tx, S.last_aggregates(tx, columns, SNAPSHOT))

    return run


@query("a1_last_gender", per_customer([f"coalesce({last_sql('customer_gender')}, 0) as customer_gender"]))
def _(spark, sf_dir):
    tx = S.with_order(lines(spark, sf_dir, "customer_gender"), SNAPSHOT, order_spans(spark, sf_dir))
    return S.aggregate_by_customer(tx, S.gender_aggregates(tx, SNAPSHOT))


query("a2_last_goods", per_customer(lasts_sql(S.LAST_GOODS)))(lasts(S.LAST_GOODS))
query("a3_last_order", per_customer(lasts_sql(S.LAST_ORDER)))(lasts(S.LAST_ORDER))
query("a4_last_member", per_customer(lasts_sql(S.LAST_MEMBER)))(lasts(S.LAST_MEMBER))


def spread(c: str):
    def run(spark, sf_dir):
        return round_std(S.aggregate_by_customer(lines(spark, sf_dir, c), X.spread(c, SNAPSHOT.money_decimals)))

    return run


query("a5_goods_price_stats", per_customer(spread_sql("goods_price")))(spread("goods_price"))
query("a6_payment_stats", per_customer(spread_sql("order_total_payment")))(spread("order_total_payment"))


@query("a7_order_count", per_customer(["count(order_id) as order_count"]))
def _(spark, sf_dir):
    return S.aggregate_by_customer(lines(spark, sf_dir), S.count_aggregates()).select("customer_id", "order_count")


@query("a7_distinct_order_count", per_customer(["count(distinct order_id) as distinct_order_count"]))
def _(spark, sf_dir):
    return S.distinct_order_counts(order_lines(spark, sf_dir, "customer_id", "order_id", "order_pay_time"), UNTIL)


@query("a8_goods_count", per_customer(["count(goods_id) as goods_count"]))
def _(spark, sf_dir):
    return S.aggregate_by_customer(lines(spark, sf_dir), S.count_aggregates()).select("customer_id", "goods_count")


def levels(c: str, prefix: str, money: bool):
    def run(spark, sf_dir):
        decimals = SNAPSHOT.money_decimals if money else None
        return S.aggregate_by_customer(lines(spark, sf_dir, c), X.level(c, prefix, decimals))

    return run


LEVEL_KEYS = (
    "a9_rate_level", "a10_detail_discount_level", "a11_member_status_level", "a12_goods_status_level",
    "a13_member_actived_level", "a14_order_status_level", "a15_goods_num_level", "a16_has_discount_level",
    "a17_payment_level", "a18_total_num_level",
)
for _key, _level in zip(LEVEL_KEYS, S.LEVELS):
    query(_key, per_customer(level_sql(*_level)))(levels(*_level))


@query(
    "a19_discount_ratio",
    f"with {TX}, last as (select customer_id, {', '.join(lasts_sql(('order_detail_amount', 'order_detail_payment')))} {SEEN})"
    " select *, order_detail_amount_last / nullif(order_detail_payment_last, 0) as discount_ratio from last",
)
def _(spark, sf_dir):
    return S.with_discount_ratio(lasts(("order_detail_amount", "order_detail_payment"))(spark, sf_dir))


# Order dates carry no time of day, so the time parts are taken from events.
PARTS = (("m", "month"), ("d", "day"), ("h", "hour"), ("min", "minute"), ("s", "second"))
PARTS_SQL = ", ".join(f"cast({part}(order_pay_time_last) as int) as order_pay_time_last_{name}" for name, part in PARTS)
LAST_EVENT = f"with {EVENT_TX}, last as (select customer_id, max(order_pay_time) as order_pay_time_last from tx group by 1)"


def last_event(spark, sf_dir):
    last = X.latest("order_pay_time", ("order_pay_time",)).alias("order_pay_time_last")
    return event_lines(spark, sf_dir).groupBy("customer_id").agg(last)


@query("d1t_time_parts", f"{LAST_EVENT} select customer_id, {PARTS_SQL} from last")
def _(spark, sf_dir):
    parts = X.time_parts("order_pay_time_last", "order_pay_time_last")
    return last_event(spark, sf_dir).select("customer_id", *parts[:-1])


WEEKDAY_SQL = "cast(isodow(order_pay_time_last) - 1 as int) as order_pay_time_last_weekday"


@query("d2t_weekday", f"{LAST_EVENT} select customer_id, {WEEKDAY_SQL} from last")
def _(spark, sf_dir):
    return last_event(spark, sf_dir).select(
        "customer_id", X.time_parts("order_pay_time_last", "order_pay_time_last")[-1]
    )


def days_sql(c: str) -> str:
    return f"cast(date_diff('day', date '{SNAPSHOT.epoch}', cast({c} as date)) as int)"


TIMES = ("order_pay_time", "goods_list_time", "goods_delist_time")
DAYS_SQL = [
    f"{days_sql('order_pay_time_last')} as order_pay_time_last_diff",
    f"{days_sql('goods_list_time_last')} as goods_list_time_diff",
    f"{days_sql('goods_delist_time_last')} as goods_delist_time_diff",
]
LIFETIME_SQL = f"{days_sql('goods_delist_time_last')} - {days_sql('goods_list_time_last')} as goods_time_diff"
LAST_TIMES = f"with {TX}, last as (select customer_id, {', '.join(lasts_sql(TIMES))} {SEEN})"


@query("d3t_epoch_days", f"{LAST_TIMES} select customer_id, {', '.join(DAYS_SQL)} from last")
def _(spark, sf_dir):
    features = S.with_calendar(lasts(TIMES)(spark, sf_dir), SNAPSHOT)
    return features.select("customer_id", "order_pay_time_last_diff", "goods_list_time_diff", "goods_delist_time_diff")


@query("d4t_lifetime", f"{LAST_TIMES} select customer_id, {LIFETIME_SQL} from last")
def _(spark, sf_dir):
    return S.with_calendar(lasts(TIMES)(spark, sf_dir), SNAPSHOT).select("customer_id", "goods_time_diff")


def snapshot_sql(until: str, goods_num: bool = True, ratio: bool = False) -> str:
    """CTEs ending in ``snapshot``: all features at ``until``."""
    columns = [f"coalesce({last_sql('customer_gender')}, 0) as customer_gender"]
    columns += lasts_sql(S.LAST_GOODS + S.LAST_ORDER + S.LAST_MEMBER)
    columns += spread_sql("goods_price") + spread_sql("order_total_payment")
    columns += ["count(order_id) as order_count", "count(goods_id) as goods_count"]
    for level in S.LEVELS:
        if level[0] == "order_detail_goods_num" and not goods_num:
            continue
        columns += level_sql(*level)[1:] if level[0] == "order_total_payment" else level_sql(*level)
    ratio_sql = ", order_detail_amount_last / nullif(order_detail_payment_last, 0) as discount_ratio" if ratio else ""
    return (
        f"last as (select customer_id, {', '.join(columns)} from tx where order_pay_time <= timestamp '{until}'"
        f" group by customer_id), snapshot as (select * exclude (order_pay_time_last, goods_list_time_last,"
        f" goods_delist_time_last), {PARTS_SQL}, {WEEKDAY_SQL}, {', '.join(DAYS_SQL)}, {LIFETIME_SQL}{ratio_sql} from last)"
    )


@query("snapshot_all", f"with {TX}, {snapshot_sql(UNTIL)} select * from snapshot")
def snapshot_all(spark, sf_dir):
    return round_std(S.snapshot_features(order_lines(spark, sf_dir), UNTIL, SNAPSHOT, order_spans(spark, sf_dir)))


@query("snapshot_ratio", f"with {TX}, {snapshot_sql(UNTIL, goods_num=False, ratio=True)} select * from snapshot")
def _(spark, sf_dir):
    return round_std(S.snapshot_features(order_lines(spark, sf_dir), UNTIL, SNAPSHOT_RATIO, order_spans(spark, sf_dir)))


def from_months(until: str):
    """Features at a cutoff from a state stored by month and the lines of the cutoff's own month, stored by month."""

    def run(spark, sf_dir):
        known, lines = order_spans(spark, sf_dir), scratch_path(spark, "order-lines")
        save_transactions(order_lines(spark, sf_dir), lines)
        tx = spark.read.parquet(lines)
        state = scratch_path(spark, "month-state")
        save_state(month_state(tx, SNAPSHOT, known), state)
        return round_std(snapshot_from_months(spark.read.parquet(state), tx, until, SNAPSHOT, known))

    return run


MID_MONTH = "2001-03-14 12:00:00"
for _key, _until in (("snapshot_from_months", UNTIL), ("snapshot_from_months_mid", MID_MONTH)):
    query(_key, f"with {TX}, {snapshot_sql(_until)} select * from snapshot")(from_months(_until))
