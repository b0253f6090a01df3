"""Every registered query of the reference's own operators, with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from govlens.plans import REGISTRIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for q, _ in REGISTRIES:
        out |= q
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for _, sql in REGISTRIES:
        out |= sql
    return out
