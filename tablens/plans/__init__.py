"""Registered queries (one module per area) and the end-to-end analysis plan."""


def load_all():
    """Import every query module so each registers its queries."""
    from . import core, modelling, sources_catalog, tables  # noqa: F401
    from .registry import ORACLES, QUERIES
    return QUERIES, ORACLES
