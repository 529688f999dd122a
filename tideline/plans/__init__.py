"""Registered queries: operators bound to tables, each with its checking SQL."""

from importlib import import_module

MODULES = ("ranking_queries", "source_queries", "align_queries", "veto_queries", "risk_queries", "outcome_queries", "text_queries", "stream_queries")


def load_queries():
    for name in MODULES:
        import_module(f"tideline.plans.{name}")
    from tideline.plans.catalogue import ORACLES, QUERIES

    return QUERIES, ORACLES
