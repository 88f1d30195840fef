"""Registered queries: each runs an operator over whole tables and states its SQL."""

from . import aggregates, biology, chains, charts, joins, loggers, statistics, tables, windows  # noqa: F401
from .registry import REGISTRY


def queries():
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql():
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}
