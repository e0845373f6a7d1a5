"""Per-customer features from all order lines up to a cutoff, in one grouped aggregation.

Each ``*_aggregates`` function returns plain aggregate columns, so any mix of them costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repurchase.functions import expressions as X
from repurchase.functions.ordering import Span, last_value, packed, spans
from repurchase.operators.labels import history
from repurchase.schema import SnapshotSpec

# The columns whose last value becomes a feature.
LAST_GOODS = (
    "goods_id",
    "goods_status",
    "goods_price",
    "goods_has_discount",
    "goods_list_time",
    "goods_delist_time",
)
LAST_ORDER = (
    "order_total_num",
    "order_amount",
    "order_total_payment",
    "order_total_discount",
    "order_pay_time",
    "order_status",
    "order_count",
    "is_customer_rate",
    "order_detail_status",
    "order_detail_goods_num",
    "order_detail_amount",
    "order_detail_payment",
    "order_detail_discount",
)
LAST_MEMBER = ("member_id", "member_status", "is_member_actived")

# Column, feature prefix, whether the values are money.
LEVELS = (
    ("is_customer_rate", "customer_rate", False),
    ("order_detail_discount", "order_detail_discount", True),
    ("member_status", "member_status", False),
    ("goods_status", "goods_status", False),
    ("is_member_actived", "is_member_actived", False),
    ("order_status", "order_status", False),
    ("order_detail_goods_num", "order_detail_goods_num", False),
    ("goods_has_discount", "goods_has_discount", False),
    ("order_total_payment", "order_total_payment", True),
    ("order_total_num", "order_total_num", False),
)

_ROW, _ORDER = "_last_row", "_order"


def with_order(tx: DataFrame, spec: SnapshotSpec, known: dict[str, Span] | None = None) -> DataFrame:
    """Add the order of lines as one number, if it can be packed.

    ``known`` are spans that hold all values of the order's columns, so that they need not be measured.
    """
    if not spec.packed:
        return tx
    key = packed(tx, spec.order, spans(tx, spec.order) if known is None else known)
    return tx if key is None else tx.withColumn(_ORDER, key)


def _latest(tx: DataFrame, c: str, spec: SnapshotSpec) -> Column:
    return last_value(c, F.col(_ORDER)) if _ORDER in tx.columns else X.latest(c, spec.order)


def gender_aggregates(tx: DataFrame, spec: SnapshotSpec) -> list[Column]:
    return [F.coalesce(_latest(tx, "customer_gender", spec), F.lit(0)).alias("customer_gender")]


def last_aggregates(tx: DataFrame, columns, spec: SnapshotSpec) -> list[Column]:
    """Last value of each column. Without a packed order, columns declared free of nulls share one ordering key."""
    if _ORDER in tx.columns or spec.nullable is None:
        return [_latest(tx, c, spec).alias(f"{c}_last") for c in columns]
    sure = [c for c in columns if c not in spec.nullable]
    shared = [X.latest_row(sure, spec.order).alias(_ROW)] if sure else []
    return shared + [X.latest(c, spec.order).alias(f"{c}_last") for c in columns if c in spec.nullable]


def unfold_last(df: DataFrame) -> DataFrame:
    """Turn the shared last row into one ``*_last`` column per value."""
    if _ROW not in df.columns:
        return df
    values = [
        X.present(F.col(_ROW).getField(c), c).alias(f"{c}_last") for c in df.schema[_ROW].dataType.fieldNames()
    ]
    return df.select(*[c for c in df.columns if c != _ROW], *values)


def spread_aggregates(spec: SnapshotSpec) -> list[Column]:
    return X.spread("goods_price", spec.money_decimals) + X.spread("order_total_payment", spec.money_decimals)


def count_aggregates() -> list[Column]:
    """Lines with an order id and lines with a goods id; neither counts distinct values."""
    return [
        F.count("order_id").cast("long").alias("order_count"),
        F.count("goods_id").cast("long").alias("goods_count"),
    ]


def level_aggregates(spec: SnapshotSpec) -> list[Column]:
    columns = []
    for name, prefix, money in LEVELS:
        if name == "order_detail_goods_num" and not spec.goods_num:
            continue
        pair = X.level(name, prefix, spec.money_decimals if money else None)
        # The payment mean is already among the spread features.
        columns += pair[1:] if name == "order_total_payment" else pair
    return columns


def with_calendar(df: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Add time parts and day counts, drop the timestamps they came from."""
    listed, delisted = (X.days_since(spec.epoch, f"goods_{kind}_time_last") for kind in ("list", "delist"))
    return df.select(
        "*",
        *X.time_parts("order_pay_time_last", "order_pay_time_last"),
        X.days_since(spec.epoch, "order_pay_time_last").alias("order_pay_time_last_diff"),
        listed.alias("goods_list_time_diff"),
        delisted.alias("goods_delist_time_diff"),
        (delisted - listed).alias("goods_time_diff"),
    ).drop("goods_list_time_last", "goods_delist_time_last", "order_pay_time_last")


def with_discount_ratio(df: DataFrame) -> DataFrame:
    """Last line amount over last line payment; null when nothing was paid."""
    ratio = F.try_divide(F.col("order_detail_amount_last"), F.col("order_detail_payment_last"))
    return df.withColumn("discount_ratio", ratio)


def aggregate_by_customer(tx: DataFrame, columns: list[Column]) -> DataFrame:
    return unfold_last(tx.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(*columns))


def snapshot_features(
    tx: DataFrame, until, spec: SnapshotSpec = SnapshotSpec(), known: dict[str, Span] | None = None
) -> DataFrame:
    """All snapshot features of every customer with an order line at or before ``until``."""
    lines = with_order(history(tx, until), spec, known)
    columns = (
        gender_aggregates(lines, spec)
        + last_aggregates(lines, LAST_GOODS + LAST_ORDER + LAST_MEMBER, spec)
        + spread_aggregates(spec)
        + count_aggregates()
        + level_aggregates(spec)
    )
    features = with_calendar(aggregate_by_customer(lines, columns), spec)
    return with_discount_ratio(features) if spec.discount_ratio else features


def distinct_order_counts(tx: DataFrame, until) -> DataFrame:
    """Number of different orders per customer, next to the line count of ``order_count``."""
    lines = history(tx, until).where(F.col("customer_id").isNotNull())
    return lines.groupBy("customer_id").agg(F.count_distinct("order_id").alias("distinct_order_count"))
