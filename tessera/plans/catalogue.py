"""All registered queries of the knowledge-graph engine, each with its DuckDB equivalent."""

from __future__ import annotations

from importlib import import_module

#: modules of this package that define QUERIES and ORACLES
MODULES = ["store_queries", "answer_queries", "rule_queries", "diagnose_queries", "text_queries", "stream_queries", "reason_queries", "session_queries", "chain_queries", "mention_queries", "match_queries", "diagnosis_queries", "lookup_queries"]


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), attribute)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
