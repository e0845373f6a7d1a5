"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _cell(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "~nan"
        return repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, sf_dir: str, entry) -> str | None:
    """None if equal, else what differs."""
    df = entry.run(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "the plan pairs all rows"
    got, got_names = _canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(entry.sql)
    want, want_names = _canonical([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL gives {len(want)}"
    if not want:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(n, a, b) for n, a, b in zip(got_names, g, w) if a != b]
        return f"{len(bad)} rows differ, first: {cells[:4]}"
    return None
