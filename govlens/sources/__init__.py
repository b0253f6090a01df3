"""Sources of the governance engine."""
