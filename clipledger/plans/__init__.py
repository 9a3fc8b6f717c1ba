"""Registered queries on the driver tables."""

import importlib

MODULES = ["timeline", "tracks", "scores", "identity", "catalog", "labels", "metrics", "sources"]


def all_queries():
    """Import every query module and return the queries and their SQL."""
    from clipledger.plans.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"clipledger.plans.{name}")
    return QUERIES, ORACLES
