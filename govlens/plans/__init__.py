"""Registered query plans: each module offers ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from govlens.plans import catalogue, discovery, entities, extras, findings, further, governance, jobs, lineage, quality, value, workflow

REGISTRIES: list = [(m.QUERIES, m.ORACLE) for m in (quality, catalogue, lineage, value, governance, discovery, entities, jobs, extras, workflow, further, findings)]
