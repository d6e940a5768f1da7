"""Registered queries, each next to the SQL an independent engine checks it with."""

from __future__ import annotations

from cubegraph.plans.registered import analytics, anomalies, exchange, graph, load, territory, texts
from cubegraph.plans.registered.base import Query

MODULES = (load, analytics, territory, graph, anomalies, texts, exchange)


def all_queries() -> dict[str, Query]:
    return {q.name: q for module in MODULES for q in module.QUERIES.values()}
