"""All registered queries, by module."""

from __future__ import annotations

from codelattice.plans import finding_queries, graph_queries, score_queries, source_queries

MODULES = [graph_queries, score_queries, finding_queries, source_queries]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
