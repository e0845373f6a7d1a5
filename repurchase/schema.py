"""The order-line table, its column groups, and the settings of the feature families."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import types as T

# Column names and types of the order-line table, in file order. Flags and counts whose
# file text carries a decimal point are read as double and narrowed afterwards.
ORDER_LINE_COLUMNS = (
    ("order_detail_id", "long"),
    ("order_id", "long"),
    ("order_total_num", "double"),
    ("order_amount", "double"),
    ("order_total_payment", "double"),
    ("order_total_discount", "double"),
    ("order_pay_time", "timestamp_ntz"),
    ("order_status", "int"),
    ("order_count", "double"),
    ("is_customer_rate", "int"),
    ("order_detail_status", "int"),
    ("order_detail_goods_num", "double"),
    ("order_detail_amount", "double"),
    ("order_detail_payment", "double"),
    ("order_detail_discount", "double"),
    ("customer_province", "string"),
    ("customer_city", "string"),
    ("member_id", "long"),
    ("customer_id", "long"),
    ("customer_gender", "int"),
    ("member_status", "int"),
    ("is_member_actived", "int"),
    ("goods_id", "long"),
    ("goods_class_id", "long"),
    ("goods_price", "double"),
    ("goods_status", "int"),
    ("goods_has_discount", "int"),
    ("goods_list_time", "timestamp_ntz"),
    ("goods_delist_time", "timestamp_ntz"),
)

ID_COLUMNS = ("order_detail_id", "order_id", "customer_id", "goods_id", "goods_class_id", "member_id")
FLAG_COLUMNS = (
    "order_status",
    "goods_has_discount",
    "is_member_actived",
    "member_status",
    "customer_gender",
    "is_customer_rate",
    "order_detail_status",
)
TIME_COLUMNS = ("order_pay_time", "goods_list_time", "goods_delist_time")
# Partition column of stored order lines: pay month as yyyymm.
MONTH_COLUMN = "pay_month"
# Columns that may hold nulls.
NULLABLE_COLUMNS = (
    "customer_province",
    "customer_city",
    "customer_gender",
    "member_id",
    "member_status",
    "is_member_actived",
    "goods_price",
)

SUBMISSION_SCHEMA = T.StructType(
    [T.StructField("customer_id", T.LongType()), T.StructField("result", T.DoubleType())]
)


def order_line_file_schema() -> T.StructType:
    """Types as found in the CSV text: every number but the plain ids as double, times as string."""
    text_types = {"timestamp_ntz": T.StringType(), "string": T.StringType()}
    plain_longs = set(ID_COLUMNS) - {"member_id"}
    return T.StructType(
        [
            T.StructField(name, T.LongType() if name in plain_longs else text_types.get(kind, T.DoubleType()))
            for name, kind in ORDER_LINE_COLUMNS
        ]
    )


@dataclass(frozen=True)
class SnapshotSpec:
    """Settings of the per-customer snapshot features.

    ``order`` defines "last": pay time first, then whatever breaks its ties. It should name each line of a customer;
    where lines share all of it, set ``packed`` to False, and the larger value counts. ``packed`` turns the order into one
    number, for which its columns are measured first; an order too wide for that is compared as it is. Only then
    ``nullable`` matters: it lists the columns whose last value may have to come from an earlier row; ``None``, the
    safe default, means any of them. Naming them (``NULLABLE_COLUMNS``) is faster, and raises an error where another
    column holds a null.
    ``money_decimals`` switches sums and means of money to exact sums in units of 10**-decimals,
    which do not depend on the order of addition. ``goods_num`` and ``discount_ratio`` choose between
    the two published feature lists.
    """

    epoch: date = date(2012, 10, 11)
    order: tuple[str, ...] = ("order_pay_time", "order_id", "order_detail_id")
    packed: bool = True
    nullable: tuple[str, ...] | None = None
    money_decimals: int | None = None
    goods_num: bool = True
    discount_ratio: bool = False


@dataclass(frozen=True)
class RollingSpec:
    """Settings of the rolling-window features; all windows end on the day before ``until``."""

    # Window lengths, shift, decay and horizon of the published features.
    payment_windows: tuple[int, ...] = (14, 30, 60, 91)
    goods_windows: tuple[int, ...] = (21, 49, 84)
    shift: int = 7
    decay: float = 0.9
    horizon: int = 30
    # Aggregates that are off by default: any of mean, median, min, std, diff_mean, decay_sum.
    extra: tuple[str, ...] = ()


@dataclass(frozen=True)
class GbtParams:
    """Settings of a gradient-boosted tree classifier with logistic loss."""

    max_iter: int
    step_size: float
    max_depth: int
    min_instances: int = 1
    seed: int = 0
    subsampling_rate: float = 1.0
    max_bins: int = 64
    checkpoint_interval: int = 10
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class BoostParams:
    """Settings of boosted trees with L1 and L2 penalties on the values of leaves."""

    max_iter: int
    step_size: float
    max_depth: int
    l1: float = 0.0
    l2: float = 0.0
    min_instances: int = 1
    seed: int = 0
    max_bins: int = 64
    # Rounds between two writes of margins and model.
    store_every: int = 20


# The two learner configurations. Spark grows trees level by level, so the leaf-wise one
# (31 leaves) becomes depth 5; its L1/L2 penalties have no counterpart.
LEAFWISE = GbtParams(max_iter=2500, step_size=0.005, max_depth=5, min_instances=3, seed=2021)
DEPTHWISE = GbtParams(max_iter=100, step_size=0.1, max_depth=6)
# The leaf-wise configuration with its penalties, for trees with penalised leaves.
LEAFWISE_PENALISED = BoostParams(max_iter=2500, step_size=0.005, max_depth=5, l1=0.25, l2=0.25, min_instances=3, seed=2021)
