"""From scores to yes/no decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.operators.ranking import cut_rows, upto_cut


def attach_scores(
    template: DataFrame, scores: DataFrame, on: str = "customer_id", score: str = "score", default: float = 0.0
) -> DataFrame:
    """Every customer of the template with their score, ``default`` where there is none."""
    joined = template.select(on).join(scores.select(on, score), on, "left")
    return joined.withColumn(score, F.coalesce(F.col(score), F.lit(default)))


def by_threshold(df: DataFrame, score: str, threshold: float, name: str = "result") -> DataFrame:
    """1 where the score is above the threshold, else 0."""
    return df.withColumn(name, F.when(F.col(score) > threshold, 1).otherwise(0))


def label_top_n(
    df: DataFrame, score: str, n: int, tie: str, inclusive: bool = False, name: str = "result"
) -> DataFrame:
    """1 for the ``n`` highest scores, else 0; ``inclusive`` marks one more. ``tie`` must be unique.

    Brackets find the last row marked; the rows are flagged where they are. Rows without score come last.
    """
    cut = n + 1 if inclusive else n
    last = cut_rows(df, score, tie, [cut])[cut]
    # Without such a row there are none to mark, or all.
    chosen = F.lit(cut > 0) if last is None else upto_cut(df, score, tie, last)
    return df.withColumn(name, chosen.cast("int"))


def topn_sweep(df: DataFrame, score: str, label: str, ns: Sequence[int], tie: str) -> DataFrame:
    """Balanced accuracy of labelling the top n, for each n: the last row of each n, and one aggregation."""
    cuts = cut_rows(df, score, tie, ns)
    one, zero = F.col(label) == 1, F.col(label) == 0
    ones, zeros = F.count(F.when(one, 1)), F.count(F.when(zero, 1))

    def entry(n: int):
        chosen = F.lit(n > 0) if cuts[n] is None else upto_cut(df, score, tie, cuts[n])
        hit = F.try_divide(F.count(F.when(one & chosen, 1)), ones)
        spared = F.try_divide(F.count(F.when(zero & ~chosen, 1)), zeros)
        both = (F.coalesce(hit, spared) + F.coalesce(spared, hit)) / 2
        return F.struct(F.lit(n).cast("long").alias("n"), both.alias("balanced_accuracy"))

    return df.agg(F.array(*[entry(n) for n in ns]).alias("r")).select(F.inline("r"))
