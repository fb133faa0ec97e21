"""The registered queries: each has a Spark form and, where SQL can say the same, an oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = ("patterns", "builder", "sources", "reasoning", "streams", "learning")


def load():
    """Import every workload module and return (queries, oracles)."""
    for name in MODULES:
        import_module(f"workloads.{name}")
    from workloads.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
