"""Connected components of a link table: the engine's alternating stars, under the names that near dedup uses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from govlens.operators import graph


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of an edge; component is its component's least id."""
    return graph.components(edges, a, b)
