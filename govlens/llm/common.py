"""Shared helpers: scratch tables in the cluster's shared folder, ASCII lower-casing, bounds of Arrow batches."""

from __future__ import annotations

import string

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from govlens.functions.scratch import drop, gone, scratch, shared_dir, table

__all__ = ["WORD", "ascii_lower", "drop", "gone", "scratch", "shared_dir", "small_batches", "table"]

#: Separators of words: space and the ASCII controls 0x09 to 0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def small_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Bounds Arrow batches by rows and by bytes, so that long texts don't add up in a Python worker.

    What is returned is lazy, so the bounds stay set in the session; no result depends on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
