"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from repurchase.catalog import load
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, e in CATALOG.items() if e.sql is not None])
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, CATALOG[name]) is None


# Fits of 100 rounds each; the first two stand for the others unless REPURCHASE_SLOW is set.
FITS = [n for n in CATALOG if n.startswith(("t4", "t5", "t6"))]
SKIPPED = [] if os.environ.get("REPURCHASE_SLOW") else [n for n in FITS if n not in ("t4_gbt_depthwise", "t6_snapshot_forecast")]


@pytest.mark.parametrize("name", [n for n, e in CATALOG.items() if e.sql is None and n not in SKIPPED])
def test_gives_rows(spark, name):
    assert CATALOG[name].run(spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    ranked = entry.entry(spark)
    assert ranked.where("chosen = 1").count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
