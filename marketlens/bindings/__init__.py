"""Registered queries: every operator on the supplied tables, with SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("values", "listings", "catalogue", "texts", "jobs", "streams", "files", "snapshots", "reviews")


def registry() -> dict:
    out: dict = {}
    for module in _MODULES:
        found = import_module(f"{__name__}.{module}").QUERIES
        doubled = set(out) & set(found)
        if doubled:
            raise ValueError(f"registered twice: {sorted(doubled)}")
        out |= found
    return out
