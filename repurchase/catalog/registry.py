"""Registered queries: name -> (function of session and data folder, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a function under ``name``; without ``sql`` only its rows can be checked."""

    def add(run):
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = Entry(run, sql)
        return run

    return add
