"""All queries of the core library."""

from __future__ import annotations

from weftgraph.plans import extract, graph, references, text

_MODULES = (references, graph, text, extract)


def queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
