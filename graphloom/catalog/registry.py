"""All registered queries, in one place."""

from __future__ import annotations

from graphloom.catalog import feature_queries, graph_queries, learning_queries, metric_queries, source_queries
from graphloom.catalog.tables import Query

MODULES = (graph_queries, source_queries, feature_queries, metric_queries, learning_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, (query, _) in module.CATALOG.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.CATALOG.items() if sql is not None}
