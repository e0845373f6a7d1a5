"""Min-max scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repurchase.sources.storage import Statistics


def value_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """(low, high) of each column. One scan; the driver receives one row and uses it as literals.

    Literals keep the plan of a wide table small, where a subquery per column would multiply it.
    """
    pairs = [F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns]
    row = df.agg(*pairs).first()
    return {c: (row[c]["low"], row[c]["high"]) for c in columns}


def minmax_scale(
    df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, known: Statistics | None = None
) -> DataFrame:
    """Columns scaled to the range they have in ``fit_on``, by default in ``df`` itself.

    Scale train and score tables with ``fit_on=train`` so that equal values stay equal, or with the statistics ``known``
    of the training table, which need no scan. A constant column becomes null.
    """
    ranges = {c: known.span(c) for c in columns} if known else value_ranges(df if fit_on is None else fit_on, columns)

    def scaled(c: str) -> Column:
        low, high = (F.lit(end) for end in ranges[c])
        return F.try_divide((F.col(c) - low).cast("double"), (high - low).cast("double"))

    return df.withColumns({c: scaled(c) for c in columns})
