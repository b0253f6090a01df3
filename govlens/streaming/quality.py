"""Streaming forms: windowed quality metrics and uniqueness, run-event edges without repeats, prompt guardrail with two sinks, silent groups."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from govlens.functions.scratch import shared_dir
from govlens.operators import entities


def windowed_quality(events: DataFrame, ts: str, value: str, group: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """day, group, rows, present, completeness, valid per window; rows later than the watermark are dropped when streaming."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), group)
    out = out.agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("present"), F.count_if(F.col(value) >= 0).alias("valid"))
    return out.select(F.col("w.start").alias("day"), group, "n_rows", "present", (F.col("present") / F.col("n_rows")).alias("completeness"), "valid")


def distinct_edges(events: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Edges of a stream of run events, each once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["src", "dst", "operation"])


def windowed_uniqueness(events: DataFrame, ts: str, value: str, group: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """day, group, n_rows, distinct_values, repeated, uniqueness (percent) of a column per window that the watermark has closed.

    Two stateful steps in a row: rows per value of a window, then values of a window. So state is one row a value while its window is open, no
    set of values is ever held together, and rows later than the watermark are dropped before either step. A null is no value.
    """
    per = events.withWatermark(ts, late).filter(F.col(value).isNotNull()).groupBy(F.window(ts, window).alias("w"), group, value).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(F.window(F.window_time("w"), window).alias("w"), group).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.select(F.col("w.start").alias("day"), group, "n_rows", "distinct_values", "repeated", (100.0 * F.col("distinct_values") / F.col("n_rows")).alias("uniqueness"))


def heartbeat(events: DataFrame, ts: str, group: str, late: str = "1 hour") -> DataFrame:
    """group and its latest time."""
    return events.withWatermark(ts, late).groupBy(group).agg(F.max(ts).alias("latest"))


class _Silence(StatefulProcessor):
    """Keeps a group's latest time and a timer that fires once the watermark is so much later."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        old = self.latest.get()[0] if self.latest.exists() else None
        new = max(r["ms"] for r in rows)
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old + self.after_ms)
            self.latest.update((new,))
            self.handle.registerTimer(new + self.after_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield Row(group=key[0], latest_ms=self.latest.get()[0])

    def close(self) -> None:
        pass


def silent(events: DataFrame, ts: str, group: str, after_seconds: int, late: str = "1 hour") -> DataFrame:
    """group (as text) and its latest_ms, once for every time that a group has had no event for so long by the watermark.

    A group that speaks again starts anew. State is one number and one timer a group; a stream needs RocksDB as its state store (``rocksdb``).
    """
    own = events.withWatermark(ts, late).select(F.col(group).cast("string").alias("group"), F.unix_millis(ts).alias("ms"), ts).filter(F.col("group").isNotNull() & F.col("ms").isNotNull())
    kind = StructType([StructField("group", StringType()), StructField("latest_ms", LongType())])
    return own.groupBy("group").transformWithState(_Silence(1000 * after_seconds), kind, "Append", "EventTime")


def guardrail(prompts: DataFrame, sent: str, blocked: str, key: str, text: str = "text", state: str | None = None):
    """A started stream that screens prompts and deals them to two sinks: sent (key, action, sent) and blocked (key, action, risk).

    Each batch is decided by itself, row by row, without state, shuffle or scratch table, and read once for both sinks. A batch that runs again after a
    failure overwrites its own folder in either sink, so no row is written twice.
    """

    def both(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            kept.filter("action <> 'block'").select(key, "action", "sent").write.mode("overwrite").parquet(f"{sent}/batch={number}")
            kept.filter("action = 'block'").select(key, "action", "risk").write.mode("overwrite").parquet(f"{blocked}/batch={number}")
        finally:
            kept.unpersist()

    state = state or f"{shared_dir(prompts.sparkSession)}/guardrail-{uuid.uuid4().hex}"
    return entities.screened(prompts, key, text).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(both).start()


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """RocksDB as the state store of the streams that start within."""
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the Parquet files of a path, a folder or a file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern
    return spark.readStream.schema(schema).parquet(path)


def run_to_table(spark: SparkSession, path: str, schema, plan: Callable[[DataFrame], DataFrame], name: str, mode: str = "complete") -> DataFrame:
    """Runs a plan over all files of a path as a stream that stops when there is nothing more, and reads its result."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        plan(source(spark, path, schema))
        .writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda b, e: b.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out"))
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
