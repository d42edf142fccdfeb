"""All queries of the library and their SQL."""

from __future__ import annotations

from weftgraph.plans import build_queries, graph_queries, operations_queries, registry, retrieval_queries, service_queries  # noqa: F401  (they register)


def queries() -> dict:
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
