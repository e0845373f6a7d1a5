"""Snapshot features from a mergeable state: one stored row per customer and month.

A state row holds what the features need of one month: counts, exact sums, squared deviations, extremes and the last
values. Rows of different months merge, so features at a cutoff take whole months from the stored state and read order
lines of the cutoff's own month only, however long the history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repurchase.functions import expressions as X
from repurchase.functions.ordering import Span
from repurchase.operators import snapshot as S
from repurchase.operators.labels import history
from repurchase.schema import MONTH_COLUMN, SnapshotSpec

_SPREADS = ("goods_price", "order_total_payment")
_KEYS = ("customer_id", MONTH_COLUMN)
_LASTS = S.LAST_GOODS + S.LAST_ORDER + S.LAST_MEMBER + ("customer_gender",)


def _measures() -> dict[str, bool]:
    """Column -> whether it is money, for all columns of which sums are kept."""
    return {name: money for name, _, money in S.LEVELS} | dict.fromkeys(_SPREADS, True)


def _sum(c: str, money: bool, spec: SnapshotSpec) -> Column:
    """Aggregate: whole units as a decimal where sums of money are exact, so that they stay exact when merged."""
    if money and spec.money_decimals is not None:
        return F.sum(F.rint(F.col(c) * float(10**spec.money_decimals)).cast("decimal(20,0)"))
    return F.sum(F.col(c).cast("double"))


def _mean(n: Column, total: Column, money: bool, spec: SnapshotSpec) -> Column:
    return F.try_divide(_plain(total, money, spec), n)


def _plain(total: Column, money: bool, spec: SnapshotSpec) -> Column:
    return total.cast("double") / float(10**spec.money_decimals) if money and spec.money_decimals is not None else total


def month_state(tx: DataFrame, spec: SnapshotSpec = SnapshotSpec(), known: dict[str, Span] | None = None) -> DataFrame:
    """One row per customer and pay month. Lines without customer or pay time are left out."""
    if spec.order[0] != "order_pay_time":
        raise ValueError("months can only be merged where pay time comes first in the order")
    lines = S.with_order(tx.where("customer_id is not null and order_pay_time is not null"), spec, known)
    lines = lines.withColumn(MONTH_COLUMN, X.month_number("order_pay_time"))
    columns = S.last_aggregates(lines, _LASTS, spec) + S.count_aggregates()
    for c, money in _measures().items():
        columns += [F.count(c).alias(f"{c}_n"), _sum(c, money, spec).alias(f"{c}_total")]
    for c in _SPREADS:
        value = F.col(c).cast("double")
        columns += [(F.var_pop(value) * F.count(c)).alias(f"{c}_squares"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    return S.unfold_last(lines.groupBy(*_KEYS).agg(*columns))


def save_state(state: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per month; ``mode="overwrite"`` replaces the months that occur in ``state`` and keeps the others.

    The tasks that made the rows write them, without a further shuffle.
    """
    writer = state.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH_COLUMN).parquet(path, compression="zstd")


def merge_months(state: DataFrame, spec: SnapshotSpec = SnapshotSpec()) -> DataFrame:
    """Snapshot features from the state rows of each customer.

    The squared deviations of several months add up with those of their means around the common mean, which a window
    over the few rows of a customer supplies: nothing cancels out, and one exchange serves both steps.
    """
    measures = _measures()
    whole = Window.partitionBy("customer_id")
    around = {}
    for c in _SPREADS:
        n, total = F.col(f"{c}_n"), F.col(f"{c}_total")
        common = _mean(F.sum(n).over(whole), F.sum(total).over(whole), True, spec)
        away = _mean(n, total, True, spec) - common
        around[f"{c}_squares"] = F.col(f"{c}_squares") + n * away * away
    state = state.withColumns(around)
    columns = [F.max_by(f"{c}_last", F.when(F.col(f"{c}_last").isNotNull(), F.col(MONTH_COLUMN))).alias(f"{c}_last") for c in _LASTS]
    columns += [F.sum(c).alias(c) for c in ("order_count", "goods_count")]
    columns += [F.sum(f"{c}_{part}").alias(f"{c}_{part}") for c in measures for part in ("n", "total")]
    for c in _SPREADS:
        columns += [F.sum(f"{c}_squares").alias(f"{c}_squares"), F.max(f"{c}_max").alias(f"{c}_max"), F.min(f"{c}_min").alias(f"{c}_min")]
    merged = state.groupBy("customer_id").agg(*columns)
    mean = {c: _mean(F.col(f"{c}_n"), F.col(f"{c}_total"), money, spec) for c, money in measures.items()}
    total = {c: F.coalesce(_plain(F.col(f"{c}_total"), money, spec), F.lit(0.0)) for c, money in measures.items()}
    out = [F.coalesce("customer_gender_last", F.lit(0)).alias("customer_gender")]
    out += [F.col(f"{c}_last") for c in _LASTS if c != "customer_gender"]
    for c in _SPREADS:
        deviation = F.sqrt(F.when(F.col(f"{c}_n") > 1, F.col(f"{c}_squares") / (F.col(f"{c}_n") - 1)))
        out += [mean[c].alias(f"{c}_mean"), deviation.alias(f"{c}_std"), F.col(f"{c}_max"), F.col(f"{c}_min")]
    out += [F.col("order_count"), F.col("goods_count")]
    for name, prefix, _ in S.LEVELS:
        if name == "order_detail_goods_num" and not spec.goods_num:
            continue
        # The payment mean is already among the spread features.
        out += [] if name in _SPREADS else [mean[name].alias(f"{prefix}_mean")]
        out.append(total[name].alias(f"{prefix}_sum"))
    features = S.with_calendar(merged.select("customer_id", *out), spec)
    return S.with_discount_ratio(features) if spec.discount_ratio else features


def snapshot_from_months(
    state: DataFrame, tx: DataFrame, until, spec: SnapshotSpec = SnapshotSpec(), known: dict[str, Span] | None = None
) -> DataFrame:
    """Equal to ``snapshot_features(tx, until)``: whole months from ``state``, lines of the cutoff's month from ``tx``.

    ``state`` must hold all months before that one; later ones are not read.
    """
    month = X.month_number(X.as_timestamp(until))
    own = history(tx, until)
    # On a table stored by month only that month is read; otherwise the time itself tells.
    first = F.date_trunc("month", X.as_timestamp(until)).cast("timestamp_ntz")
    own = own.where(F.col("order_pay_time") >= first)
    if MONTH_COLUMN in tx.columns:
        own = own.where(F.col(MONTH_COLUMN) == month)
    partial = month_state(own.drop(MONTH_COLUMN), spec, known)
    return merge_months(state.where(F.col(MONTH_COLUMN) < month).unionByName(partial), spec)
