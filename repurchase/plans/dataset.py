"""Feature tables with and without label, at a cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from repurchase.functions.ordering import Span
from repurchase.operators.clean import narrow_types
from repurchase.operators.labels import buyers, future, with_membership
from repurchase.operators.rolling import daily_sums, rolling_features, rolling_features_at
from repurchase.operators.snapshot import snapshot_features
from repurchase.schema import RollingSpec, SnapshotSpec


def snapshot_dataset(
    tx: DataFrame, until, is_train: bool, spec: SnapshotSpec = SnapshotSpec(), known: dict[str, Span] | None = None
) -> DataFrame:
    """Snapshot features at ``until``; for training with the open-horizon label.

    Features and later buyers are both partitioned by customer already when they are joined.
    """
    features = snapshot_features(tx, until, spec, known)
    if not is_train:
        return features
    return with_membership(features, buyers(future(tx, until)), "customer_id", "label")


def rolling_dataset(
    tx: DataFrame,
    start,
    until,
    is_train: bool,
    spec: RollingSpec = RollingSpec(),
    population: str = "history",
    decimals: int | None = None,
    narrow: bool = False,
) -> DataFrame:
    """Rolling features at ``until`` from lines after ``start``; for training with the fixed-horizon label.

    ``narrow`` gives every feature the narrowest type that holds its range, for which the features are computed once
    more; narrow a stored table with its statistics instead where that matters.
    """
    daily = daily_sums(tx, start, decimals=decimals)
    features = rolling_features(daily, until, spec, label=is_train, population=population)
    kept = ("customer_id", "label")
    return narrow_types(features, [c for c in features.columns if c not in kept])[0] if narrow else features


def rolling_datasets(
    tx: DataFrame, start, untils: Sequence, is_train: bool, spec: RollingSpec = RollingSpec(), decimals: int | None = None
) -> DataFrame:
    """Rolling data sets at several cutoffs below each other, named by ``until``, from one scan of the lines."""
    return rolling_features_at(daily_sums(tx, start, decimals=decimals), untils, spec, label=is_train)


def build_dataset(tx: DataFrame, until, is_train: bool, kind: str = "snapshot", **settings) -> DataFrame:
    if kind == "snapshot":
        return snapshot_dataset(tx, until, is_train, **settings)
    if kind == "rolling":
        return rolling_dataset(tx, until=until, is_train=is_train, **settings)
    raise ValueError(f"kind must be 'snapshot' or 'rolling', not {kind!r}")
