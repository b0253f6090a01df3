"""Functions of the governance engine."""
