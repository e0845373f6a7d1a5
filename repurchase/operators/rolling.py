"""Rolling-window features per customer.

Lines are summed per customer and day first, which spreads even one very large customer over the days
and shrinks the data before it is grouped by customer. All windows are then conditional aggregates of
one pass; no customer × day matrix is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repurchase.functions import expressions as X
from repurchase.functions.windows import DayWindow
from repurchase.operators.labels import horizon_label, since
from repurchase.schema import RollingSpec


def daily_sums(
    tx: DataFrame,
    start,
    key: str = "customer_id",
    time: str = "order_pay_time",
    payment: str = "order_total_payment",
    num: str = "order_total_num",
    decimals: int | None = None,
) -> DataFrame:
    """Payment and quantity per customer and day, for days after ``start``."""
    lines = since(tx, start, time).where(F.col(key).isNotNull())
    return lines.groupBy(key, F.to_date(time).alias("day")).agg(
        X.total(payment, decimals).alias("day_payment"),
        X.total(num, decimals).alias("day_num"),
    )


def daily_matrix(daily: DataFrame, days: list[date], value: str, key: str = "customer_id") -> DataFrame:
    """One column per listed day, 0 where the customer has no row. For short lists of days."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("day") == F.lit(d), F.col(value))), F.lit(0.0)).alias(f"d_{d:%Y%m%d}")
        for d in days
    ]
    return daily.groupBy(key).agg(*cells)


def payment_features(until, spec: RollingSpec, payment: Column, day: Column) -> list[Column]:
    age = F.datediff(X.day_of(until), day)
    active = payment != 0
    columns = []
    for i in spec.payment_windows:
        w = DayWindow(payment, age, i)
        columns += [
            w.decay_sum(spec.decay).alias(f"decay_sum_{i}"),
            w.max().alias(f"max_{i}"),
            w.sum().alias(f"sum_{i}"),
            *_extra(w, spec, "", f"_{i}", but=("decay_sum",)),
        ]
    for i in spec.payment_windows:
        w = DayWindow(payment, age, i, spec.shift)
        columns += [
            w.decay_sum(spec.decay).alias(f"decay_sum_{i}_2"),
            w.max().alias(f"max_{i}_2"),
            *_extra(w, spec, "", f"_{i}_2", but=("decay_sum", "diff_mean")),
        ]
    return columns + _activity(payment, age, active, spec.payment_windows, "")


def goods_features(until, spec: RollingSpec, num: Column, day: Column) -> list[Column]:
    age = F.datediff(X.day_of(until), day)
    columns = []
    for suffix, shift in (("", 0), ("_2", spec.shift)):
        for i in spec.goods_windows:
            w = DayWindow(num, age, i, shift)
            columns += [
                w.mean().alias(f"goods_mean_{i}{suffix}"),
                w.max().alias(f"goods_max_{i}{suffix}"),
                w.sum().alias(f"goods_sum_{i}{suffix}"),
                *_extra(w, spec, "goods_", f"_{i}{suffix}", but=("mean", "std") if shift else ("mean",)),
            ]
    return columns + _activity(num, age, num > 0, spec.goods_windows, "goods_")


def _activity(value: Column, age: Column, active: Column, windows, prefix: str) -> list[Column]:
    columns = []
    for i in windows:
        w = DayWindow(value, age, i)
        columns += [
            w.active_days(active).alias(f"{prefix}has_sales_days_in_last_{i}"),
            w.days_since_last(active).alias(f"{prefix}last_has_sales_day_in_last_{i}"),
            w.days_since_first(active).alias(f"{prefix}first_has_sales_day_in_last_{i}"),
        ]
    return columns


def _extra(w: DayWindow, spec: RollingSpec, prefix: str, suffix: str, but: tuple[str, ...]) -> list[Column]:
    made = {
        "mean": w.mean,
        "median": w.median,
        "min": w.min,
        "std": w.std,
        "diff_mean": w.diff_mean,
        "decay_sum": lambda: w.decay_sum(spec.decay),
    }
    return [made[name]().alias(f"{prefix}{name}{suffix}") for name in spec.extra if name not in but]


def rolling_features(
    daily: DataFrame,
    until,
    spec: RollingSpec = RollingSpec(),
    key: str = "customer_id",
    label: bool = False,
    population: str = "history",
) -> DataFrame:
    """All rolling features, and the fixed-horizon label if asked for, in one grouped aggregation.

    ``population="history"`` keeps customers with a day before ``until``; ``"all"`` keeps every
    customer of the daily table, including those first seen later.
    """
    day = F.col("day")
    columns = payment_features(until, spec, F.col("day_payment"), day)
    columns += goods_features(until, spec, F.col("day_num"), day)
    if label:
        columns.append(horizon_label(F.col("day_num"), day, until, spec.horizon).alias("label"))
    if population == "all":
        return daily.groupBy(key).agg(*columns)
    if population != "history":
        raise ValueError(f"population must be 'history' or 'all', not {population!r}")
    if not label:
        return daily.where(day < X.as_date(until)).groupBy(key).agg(*columns)
    seen = F.min(day).alias("_first_day")
    return daily.groupBy(key).agg(*columns, seen).where(F.col("_first_day") < X.as_date(until)).drop("_first_day")


def rolling_features_at(
    daily: DataFrame, untils: Sequence, spec: RollingSpec = RollingSpec(), key: str = "customer_id", label: bool = False
) -> DataFrame:
    """Rolling features at several cutoffs from one pass over the days, with the cutoff in ``until``.

    Equal to :func:`rolling_features` at each cutoff, one below the other. A day goes to the cutoffs whose windows, or
    whose label horizon, hold it, and is combined there before the shuffle; customers seen before a cutoff without a day
    in its windows come from their first day alone.
    """
    cutoffs = F.array(*[X.as_date(u) for u in untils])
    reach = max((*spec.payment_windows, *spec.goods_windows)) + spec.shift
    day = F.col("day")
    ahead = spec.horizon - 1 if label else -1
    held = F.filter(cutoffs, lambda u: F.datediff(u, day).between(-ahead, reach))
    counted = daily.select(key, "day", "day_payment", "day_num", F.explode(held).alias("until"))
    seen = daily.groupBy(key).agg(F.min(day).alias("day"))
    # Their days carry no values, so they add nothing to any window.
    none = F.lit(None).cast("double")
    before = F.filter(cutoffs, lambda u: day < u)
    seen = seen.select(key, "day", none.alias("day_payment"), none.alias("day_num"), F.explode(before).alias("until"))
    until = F.col("until")
    columns = payment_features(until, spec, F.col("day_payment"), day)
    columns += goods_features(until, spec, F.col("day_num"), day)
    if label:
        columns.append(horizon_label(F.col("day_num"), day, until, spec.horizon).alias("label"))
    features = counted.unionByName(seen).groupBy(key, "until").agg(*columns, F.min(day).alias("_first_day"))
    return features.where(F.col("_first_day") < until).drop("_first_day")
