"""Operators of the governance engine."""
