"""ETL jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions.scratch import scratch
from govlens.operators import jobs
from govlens.sources.tables import read
from govlens.streaming import quality as stream


def _raw_orders(spark, d):
    return read(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE string(o_orderkey) END AS order_id", "string(o_custkey) AS customer_id", "string(o_totalprice) AS order_total", "CASE WHEN o_orderkey % 3 = 0 THEN '10.5' END AS discount", "string(o_orderdate) AS updated_at", "CASE WHEN o_orderkey % 7 <> 0 THEN lower(o_orderstatus) END AS status")


def clean_orders(spark, d):
    return jobs.clean_orders(_raw_orders(spark, d))


_ORDERS = """co AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS order_total, CASE WHEN o_orderkey % 3 = 0 THEN 10.5 ELSE 0 END::DOUBLE AS discount, o_orderdate AS updated_at, CASE WHEN o_orderkey % 7 <> 0 THEN upper(o_orderstatus) ELSE 'UNKNOWN' END AS status FROM orders WHERE o_orderkey % 50 <> 0)"""


def clean_customers(spark, d):
    return jobs.clean_customers(read(spark, d, "customer").selectExpr("string(c_custkey) AS customer_id", "'  ' || c_name || ' ' AS customer_name", "' ' || upper(c_name) || '@X.org' AS email", "c_mktsegment AS country"))


def enriched(spark, d):
    return jobs.enrich(clean_orders(spark, d), clean_customers(spark, d).filter("customer_id % 10 <> 0")).withColumn("net_total", F.round("net_total", 4))


def daily_revenue(spark, d):
    return jobs.daily_revenue(jobs.enrich(clean_orders(spark, d), clean_customers(spark, d))).withColumn("revenue", F.round("revenue", 2))


def call_features(spark, d):
    calls = read(spark, d, "events").select(F.col("user_id").alias("subscriber"), F.col("value").alias("seconds"))
    profiles = read(spark, d, "customer").select(F.col("c_custkey").alias("subscriber"), F.col("c_mktsegment").alias("plan"))
    out = jobs.call_features(calls, profiles)
    return out.select("subscriber", "calls", F.round("seconds", 4).alias("seconds"), F.round("mean_seconds", 6).alias("mean_seconds"), "plan")


def segments(spark, d):
    return jobs.segment(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


def daily_quality(spark, d):
    """The stream's batch form."""
    return stream.windowed_quality(_valued(read(spark, d, "events")), "ts", "value", "event_type").withColumn("day", F.col("day").cast("timestamp_ntz"))


def _valued(e):
    return e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))


def stream_daily_quality(spark, d):
    path = f"{d}/events.parquet"
    return stream.run_to_table(spark, path, spark.read.parquet(path).schema, lambda s: stream.windowed_quality(_valued(s), "ts", "value", "event_type"), "stream-quality").withColumn("day", F.col("day").cast("timestamp_ntz"))


def stream_distinct_edges(spark, d):
    path = f"{d}/events.parquet"
    edge = lambda s: s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("src"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("dst"), F.lit("READ").alias("operation"))
    return stream.run_to_table(spark, path, spark.read.parquet(path).schema, lambda s: stream.distinct_edges(edge(s), "ts"), "stream-edges", mode="append").select("src", "dst", "operation")


def stream_uniqueness(spark, d):
    """Uniqueness of users per day and type of event, for the days that the watermark has closed."""
    path = f"{d}/events.parquet"
    plan = lambda s: stream.windowed_uniqueness(s.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id"), "ts", "user_id", "event_type")
    out = stream.run_to_table(spark, path, spark.read.parquet(path).schema, plan, "stream-uniqueness", mode="append")
    return out.withColumn("day", F.col("day").cast("timestamp_ntz")).withColumn("uniqueness", F.round("uniqueness", 6))


def stream_silent(spark, d):
    """Users without an event for nine hours, each time they fall silent, by timers."""
    path = f"{d}/events.parquet"
    with stream.rocksdb(spark):
        out = stream.run_to_table(spark, path, spark.read.parquet(path).schema, lambda s: stream.silent(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", 9 * 3600), "stream-silent", mode="append")
    return out.select(F.col("group").cast("long").alias("user_id"), "latest_ms")


def stream_screened(spark, d):
    """What a stream of prompts left in the sinks of sent and of blocked ones."""
    path, base = f"{d}/conversations.parquet", scratch(spark, "screened")
    prompts = stream.source(spark, path, spark.read.parquet(path).schema).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), "text")
    stream.guardrail(prompts, f"{base}/sent", f"{base}/blocked", "prompt_id").awaitTermination()
    sent, blocked = (spark.read.parquet(f"{base}/{sink}").drop("batch") for sink in ("sent", "blocked"))
    return sent.unionByName(blocked.drop("risk"), allowMissingColumns=True)


def stream_heartbeat(spark, d):
    path = f"{d}/events.parquet"
    return stream.run_to_table(spark, path, spark.read.parquet(path).schema, lambda s: stream.heartbeat(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), "stream-heartbeat").withColumn("latest", F.col("latest").cast("timestamp_ntz"))


QUERIES = {
    "etl_clean_orders": clean_orders, "etl_clean_customers": clean_customers, "etl_enriched": enriched, "etl_daily_revenue": daily_revenue, "etl_call_features": call_features, "etl_segments": segments,
    "batch_daily_quality": daily_quality, "stream_daily_quality": stream_daily_quality, "stream_distinct_edges": stream_distinct_edges, "stream_heartbeat": stream_heartbeat,
    "stream_uniqueness": stream_uniqueness, "stream_silent": stream_silent, "stream_screened": stream_screened,
}

_CUSTOMERS = "cc AS (SELECT c_custkey AS customer_id, c_name AS customer_name, lower(c_name || '@X.org') AS email, c_mktsegment AS country FROM customer)"
_DAILY = """SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n_rows, count(CASE WHEN event_id % 9 <> 0 THEN value END) AS present,
  count(CASE WHEN event_id % 9 <> 0 THEN value END) / count(*) AS completeness, count(*) FILTER (event_id % 9 <> 0 AND value >= 0) AS valid FROM events GROUP BY 1, 2"""

ORACLE = {
    "etl_clean_orders": f"WITH {_ORDERS} SELECT * FROM co",
    "etl_clean_customers": f"WITH {_CUSTOMERS} SELECT * FROM cc",
    "etl_enriched": f"WITH {_ORDERS}, {_CUSTOMERS} SELECT co.*, customer_name, email, country, round(order_total - discount, 4) AS net_total FROM co LEFT JOIN (SELECT * FROM cc WHERE customer_id % 10 <> 0) c USING (customer_id)",
    "etl_daily_revenue": f"WITH {_ORDERS} SELECT updated_at::DATE AS day, count(*) AS orders, round(sum(order_total - discount), 2) AS revenue FROM co GROUP BY 1",
    "etl_call_features": "WITH c AS (SELECT user_id AS subscriber, count(*) AS calls, round(sum(value), 4) AS seconds, round(avg(value), 6) AS mean_seconds FROM events GROUP BY 1) SELECT c.*, c_mktsegment AS plan FROM c LEFT JOIN customer ON subscriber = c_custkey",
    "etl_segments": "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= 8000 THEN 'gold' WHEN c_acctbal >= 4000 THEN 'silver' ELSE 'bronze' END AS segment FROM customer",
    "batch_daily_quality": _DAILY,
    "stream_daily_quality": _DAILY,
    "stream_distinct_edges": "SELECT DISTINCT event_type AS src, 'u' || (user_id % 20) AS dst, 'READ' AS operation FROM events",
    "stream_uniqueness": """WITH v AS (SELECT date_trunc('day', ts) AS day, event_type, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL)
      SELECT day, event_type, sum(n)::BIGINT AS n_rows, count(*) AS distinct_values, count(*) FILTER (n > 1) AS repeated, round(100.0 * count(*) / sum(n), 6) AS uniqueness FROM v
      WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    "stream_silent": """SELECT user_id, max(epoch_us(ts) // 1000) AS latest_ms FROM events GROUP BY user_id
      HAVING max(epoch_us(ts) // 1000) + 9 * 3600000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)""",
    "stream_heartbeat": "SELECT event_type, max(ts) AS latest FROM events GROUP BY event_type",
}
