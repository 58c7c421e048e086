"""Registered queries over the driver tables (see ``registry``)."""

from __future__ import annotations

import importlib

_MODULES = ("portfolio_queries", "transaction_queries", "scoring_queries",
            "mention_queries", "anomaly_queries", "stream_queries")


def load_all():
    """Import every query module; returns (queries, oracles)."""
    from riskloom.plans import registry
    for m in _MODULES:
        importlib.import_module(f"riskloom.plans.{m}")
    return registry.QUERIES, registry.ORACLES
