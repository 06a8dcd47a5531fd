"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERIES and SQL, in the order of the operators' numbers.
MODULES = ("ngram_join", "decontamination", "mixing", "language_id", "secret_forest", "token_files", "license_scan", "nn_descent", "substring_dedup", "sharding", "negative_mining", "lexical_search", "simhash")


def _modules():
    return [import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
