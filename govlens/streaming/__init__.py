"""Streaming of the governance engine."""
