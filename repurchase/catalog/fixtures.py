"""The order-line model expressed over the star-schema tables, in Spark and as SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repurchase.functions.ordering import Span, spans
from repurchase.schema import NULLABLE_COLUMNS, RollingSpec, SnapshotSpec

# Snapshot features: cutoff, origin of day counts, and a tie-break that makes the line order total.
UNTIL = "2001-05-31 23:59:59"
ORDER = ("order_pay_time", "order_id", "line_number", "goods_id", "supplier_id", "order_detail_goods_num")
SNAPSHOT = SnapshotSpec(epoch=date(1995, 1, 1), order=ORDER, nullable=NULLABLE_COLUMNS, money_decimals=4)
SNAPSHOT_RATIO = SnapshotSpec(
    epoch=date(1995, 1, 1), order=ORDER, nullable=NULLABLE_COLUMNS, money_decimals=4, goods_num=False,
    discount_ratio=True,
)

# Rolling features over order lines with the standard windows.
START, SINCE_UNTIL = "2000-01-01", "2001-07-02"
ROLLING = RollingSpec()

# Rolling features over events: 30 dense days.
DENSE_START, DENSE_UNTIL = "2023-12-31", "2024-01-22"
DENSE = RollingSpec(payment_windows=(7, 14), goods_windows=(7, 14), horizon=1)

MEMBER = "case when c_acctbal < 0 then null else {} end"
# column -> (expression understood by both engines, tables it needs besides lineitem and orders)
ORDER_LINES = {
    "order_id": ("l_orderkey", ""),
    "line_number": ("l_linenumber", ""),
    "supplier_id": ("l_suppkey", ""),
    "order_total_num": ("l_quantity", ""),
    "order_amount": ("o_totalprice", ""),
    "order_total_payment": ("o_totalprice", ""),
    "order_total_discount": ("l_extendedprice * l_discount", ""),
    "order_pay_time": ("o_orderdate", ""),
    "order_status": ("case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end", ""),
    "order_count": ("cast(l_linenumber as double)", ""),
    "is_customer_rate": ("case when l_returnflag = 'R' then 1 else 0 end", ""),
    "order_detail_status": ("case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end", ""),
    "order_detail_goods_num": ("l_quantity", ""),
    "order_detail_amount": ("l_extendedprice", ""),
    "order_detail_payment": ("l_extendedprice * (1 - l_discount)", ""),
    "order_detail_discount": ("l_extendedprice * l_discount", ""),
    "customer_province": (MEMBER.format("n_name"), "nation"),
    "customer_city": (MEMBER.format("c_mktsegment"), "customer"),
    "member_id": (MEMBER.format("c_custkey"), "customer"),
    "customer_id": ("o_custkey", ""),
    "customer_gender": (MEMBER.format("c_nationkey % 2"), "customer"),
    "member_status": (MEMBER.format("case when c_acctbal > 5000 then 1 else 0 end"), "customer"),
    "is_member_actived": (MEMBER.format("case when c_mktsegment = 'BUILDING' then 1 else 0 end"), "customer"),
    "goods_id": ("l_partkey", ""),
    "goods_class_id": ("p_size", "part"),
    "goods_price": ("case when l_tax = 0 then null else p_retailprice end", "part"),
    "goods_status": ("case when l_linestatus = 'O' then 1 else 0 end", ""),
    "goods_has_discount": ("case when l_discount > 0 then 1 else 0 end", ""),
    "goods_list_time": ("o_orderdate", ""),
    "goods_delist_time": ("l_shipdate", ""),
}

TX = (
    "tx as (select "
    + ", ".join(f"{expression} as {name}" for name, (expression, _) in ORDER_LINES.items())
    + " from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"
    " join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Order lines with the given columns (default all), joining only the tables they come from.

    Lines meet their part while they are narrow and orders their customer before the lines, so where Spark broadcasts
    neither, no wide row is shuffled for them.
    """
    columns = columns or tuple(ORDER_LINES)
    needed = {ORDER_LINES[c][1] for c in columns}
    orders = table(spark, sf_dir, "orders")
    if needed & {"customer", "nation"}:
        customer = table(spark, sf_dir, "customer")
        if "nation" in needed:
            nation = table(spark, sf_dir, "nation")
            customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem")
    if "part" in needed:
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(*[F.expr(ORDER_LINES[c][0]).alias(c) for c in columns])


def order_spans(spark: SparkSession, sf_dir: str) -> dict[str, Span]:
    """Spans of the columns that order lines, measured on the tables they come from, without a join."""
    lines = table(spark, sf_dir, "lineitem").select(*[F.expr(ORDER_LINES[c][0]).alias(c) for c in ORDER[1:]])
    orders = table(spark, sf_dir, "orders").select(F.expr(ORDER_LINES[ORDER[0]][0]).alias(ORDER[0]))
    return spans(orders, ORDER[:1], (lines, ORDER[1:]))


# Events as dense order lines: the value is paid, a purchase counts as quantity 1.
EVENT_TX = (
    "tx as (select user_id as customer_id, ts as order_pay_time, value as order_total_payment,"
    " case when event_type = 'purchase' then 1.0::double else 0.0::double end as order_total_num from events)"
)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("order_pay_time"),
        F.col("value").alias("order_total_payment"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("order_total_num"),
    )


def cents(expression: str) -> str:
    """SQL for an exact sum of money."""
    return f"coalesce(sum(cast(round({expression} * 10000.0::double) as bigint))::double / 10000.0::double, 0.0::double)"


def daily_sql(start: str) -> str:
    """CTE ``daily`` over ``tx``."""
    return (
        f"daily as (select customer_id, cast(order_pay_time as date) as day, {cents('order_total_payment')} as day_payment,"
        f" {cents('order_total_num')} as day_num from tx where cast(order_pay_time as date) > date '{start}'"
        " group by 1, 2)"
    )
