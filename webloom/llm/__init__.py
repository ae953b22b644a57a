"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage."""


def load_queries():
    from webloom.llm import queries  # noqa: F401
    from webloom.llm.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
