"""Order lines from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repurchase.functions import expressions as X
from repurchase.schema import MONTH_COLUMN, ORDER_LINE_COLUMNS, order_line_file_schema

_CORRUPT = "_broken_line"
# Java does not compile methods above 8,000 bytes; the casts of all columns in one are larger.
_VALUES_AT_ONCE = 7


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Order lines with their declared types; text that is no valid value becomes null.

    :func:`split_transactions` sets such lines of CSV files aside instead.
    """
    if fmt == "csv":
        raw = spark.read.schema(order_line_file_schema()).option("header", True).csv(path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")
    return conform(raw)


def split_transactions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(order lines, rejects) of CSV files: every line is in exactly one of them.

    A line is rejected if it has too few or too many cells, or a cell that is not empty and no value of its column's
    type. Rejects have the file, the line as it stands there, the first bad column (null if the number of cells is
    wrong) and its text. A line equal to the header is neither; a header with other names is a reject, so it shows.
    Both come from one scan of the text, and nothing is kept aside: reading them again reads the files again.
    """
    names = [name for name, _ in ORDER_LINE_COLUMNS]
    header = ",".join(names)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    lines = lines.where((F.col("line") != header) & (F.trim("line") != ""))
    cells = ", ".join(f"{name} string" for name in names) + f", {_CORRUPT} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = _computed_once(lines, F.from_csv("line", cells, options), "cells")
    found = {field.name: field.dataType.simpleString() for field in order_line_file_schema()}
    typed = [(name, kind) for name, kind in ORDER_LINE_COLUMNS if kind != "string"]
    # As the file holds it first: whole numbers may carry a decimal point.
    at = {name: f"values_{i // _VALUES_AT_ONCE}" for i, (name, _) in enumerate(typed)}
    for group in dict.fromkeys(at.values()):
        values = [F.col(f"cells.{name}").try_cast(found[name]).try_cast(kind).alias(name) for name, kind in typed if at[name] == group]
        parsed = _computed_once(parsed, F.struct(*values), group)
    bad = [F.when(F.col(f"cells.{name}").isNotNull() & F.col(f"{at[name]}.{name}").isNull(), F.lit(name)) for name, _ in typed]
    judged = _computed_once(parsed, F.coalesce(*bad), "first").withColumn("broken", F.col(f"cells.{_CORRUPT}").isNotNull())
    kept = judged.where("not broken and first is null").select(
        *[F.col(f"cells.{name}" if kind == "string" else f"{at[name]}.{name}").alias(name) for name, kind in ORDER_LINE_COLUMNS]
    )
    text = F.coalesce(*[F.when(F.col("first") == name, F.col(f"cells.{name}")) for name, _ in typed])
    refused = judged.where("broken or first is not null").select(
        "file", "line", F.when(~F.col("broken"), F.col("first")).alias("column_name"), F.when(~F.col("broken"), text).alias("text")
    )
    return conform(kept), refused


def _computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a further column, computed once per row.

    A filter is pushed below a plain column and then repeats its expression at every mention; below an ``explode`` it
    cannot go.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def conform(raw: DataFrame) -> DataFrame:
    """Order-line columns in file order with their declared types, NaN as null."""
    present = dict(raw.dtypes)
    columns = [
        _typed(F.col(name), present[name], kind).alias(name) for name, kind in ORDER_LINE_COLUMNS if name in present
    ]
    return raw.select(*columns, *[c for c in raw.columns if c == MONTH_COLUMN])


def save_transactions(tx: DataFrame, path: str) -> None:
    """Store order lines by pay month, so that cutoffs read only the months they need.

    Lines are written by the tasks that hold them, sorted by month, and not shuffled once more for it: a month gets a file
    per task, so the number of files grows with the lines and their size does not.
    """
    by_month = tx.withColumn(MONTH_COLUMN, X.month_number("order_pay_time"))
    by_month.write.mode("error").partitionBy(MONTH_COLUMN).parquet(path, compression="zstd")


def _typed(c: Column, found: str, wanted: str) -> Column:
    if found in ("double", "float"):
        c = F.when(~F.isnan(c), c)
    return c if found == wanted else c.try_cast(wanted)
