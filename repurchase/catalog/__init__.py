"""Every registered query with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from repurchase.catalog.registry import CATALOG, Entry

_MODULES = (
    "tables", "scalars", "profiles", "snapshot", "labels", "rolling", "decisions", "selection", "clusters", "models",
)


def load() -> dict[str, Entry]:
    """All registered queries by name."""
    for module in _MODULES:
        import_module(f"repurchase.catalog.{module}")
    return CATALOG
