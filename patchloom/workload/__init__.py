"""The registered queries: each operator on views over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("q_sources", "q_aggregates", "q_relational", "q_text", "q_analysis")


def _load() -> None:
    for name in MODULES:
        import_module(f"patchloom.workload.{name}")


def all_queries() -> dict[str, Callable]:
    from patchloom.workload.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from patchloom.workload.registry import ORACLES

    _load()
    return dict(ORACLES)
