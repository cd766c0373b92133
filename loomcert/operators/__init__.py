"""Relational operators; importing the modules registers their queries."""


def core_queries() -> tuple[dict, dict]:
    """The registered queries and their oracles."""
    from ..plans.registry import ORACLES, QUERIES
    from . import bags, basics, certify, graph, tpch  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
