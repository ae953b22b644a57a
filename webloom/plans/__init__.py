"""Registered queries."""

from importlib import import_module

MODULES = ["page_queries", "document_queries", "more_queries", "log_queries", "stream_queries", "edge_queries"]


def load_queries():
    for module in MODULES:
        import_module(f"webloom.plans.{module}")
    from webloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
