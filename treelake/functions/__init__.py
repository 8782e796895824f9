"""Operators of this area."""
