"""Queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("chat", "exact_dedup", "bpe", "mixing", "simhash", "toxicity", "pii", "html_text", "ann", "substring_dedup")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"treelake.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
