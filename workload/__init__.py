"""The registered queries: each binds one operator to the driver's tables, with its SQL where SQL can state it."""

from __future__ import annotations

import importlib

FAMILIES = ("records", "histories", "rankings", "streams", "estimates", "graphs", "vectors", "selections", "frontiers")


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"workload.{name}")


def all_queries():
    from workload.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql():
    from workload.registry import SQL

    _load()
    return dict(SQL)
