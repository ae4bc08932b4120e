"""Registered queries: one module per operator family."""

from importlib import import_module

FAMILIES = ("audit", "structure", "text", "evaluation", "controls", "comparison", "modelling")


def load_catalog():
    """Import every family and return (queries, oracle SQL)."""
    from spandoc.catalog.registry import ORACLES, QUERIES

    for family in FAMILIES:
        import_module(f"spandoc.catalog.{family}")
    return QUERIES, ORACLES
