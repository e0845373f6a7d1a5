"""python tests/check.py SF [name prefix …]: compare registered queries with their SQL."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from repurchase.catalog import load  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(sf: str, prefixes: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("CHECK_PARTITIONS", "8"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    failed = 0
    for name, entry in load().items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.time()
        try:
            if entry.sql is None:
                outcome = None if entry.run(spark, sf_dir).count() else "no rows"
                kind = "rows"
            else:
                outcome, kind = compare(spark, con, sf_dir, entry), "sql"
        except Exception as error:  # noqa: BLE001
            outcome = f"{type(error).__name__}: {str(error)[:600]}"
        failed += outcome is not None
        print(f"{name:28s} {kind:4s} {time.time() - start:6.2f}s {'ok' if outcome is None else 'FAIL ' + outcome}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
