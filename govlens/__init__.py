"""Governance analytics as Spark DataFrame jobs."""
