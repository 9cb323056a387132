"""All registered queries and their SQL."""

from __future__ import annotations

from stackscan.plans import queries_detect, queries_evidence, queries_history, queries_quality

_MODULES = (queries_detect, queries_evidence, queries_quality, queries_history)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.oracles().items()}
