"""Registry of queries and their oracle SQL; each module of acceptlake.plans contributes QUERIES and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("gate_queries", "policy_queries", "reporting_queries", "security_queries", "patch_queries", "textmatch_queries", "graph_queries", "source_queries", "manifest_queries", "code_queries", "streaming_queries")


def _modules():
    return [import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
