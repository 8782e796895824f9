"""Queries over the supplied tables, one per operator, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("entries", "relations", "changes", "states", "publishing")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"treelake.plans.{name}"), attribute)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
