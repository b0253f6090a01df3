"""Table-to-table jobs: cleaning, enrichment, daily revenue, call features, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_orders(raw: DataFrame) -> DataFrame:
    """order_id, customer_id, order_total, discount, updated_at, status; rows without a key go."""
    out = raw.select(
        F.col("order_id").try_cast("long").alias("order_id"),
        F.col("customer_id").try_cast("long").alias("customer_id"),
        F.col("order_total").try_cast("double").alias("order_total"),
        F.coalesce(F.col("discount").try_cast("double"), F.lit(0.0)).alias("discount"),
        F.col("updated_at").try_cast("timestamp").alias("updated_at"),
        F.upper(F.coalesce("status", F.lit("UNKNOWN"))).alias("status"),
    )
    return out.filter("order_id is not null and customer_id is not null")


def clean_customers(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("customer_id").try_cast("long").alias("customer_id"), F.trim("customer_name").alias("customer_name"), F.lower(F.trim("email")).alias("email"), F.trim("country").alias("country")).filter("customer_id is not null")


def enrich(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer, if known, and the total after discount."""
    return orders.join(customers, "customer_id", "left").withColumn("net_total", F.col("order_total") - F.col("discount"))


def daily_revenue(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(F.to_date("updated_at").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.sum("net_total").alias("revenue"))


def call_features(calls: DataFrame, profiles: DataFrame) -> DataFrame:
    """calls, seconds, mean_seconds per subscriber, left joined to the profile."""
    per = calls.groupBy("subscriber").agg(F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"))
    return per.join(profiles, "subscriber", "left")


def segment(df: DataFrame, value: str, steps=(("gold", 8000.0), ("silver", 4000.0)), rest: str = "bronze") -> DataFrame:
    out = F.when(F.col(value) >= steps[0][1], steps[0][0])
    for name, floor in steps[1:]:
        out = out.when(F.col(value) >= floor, name)
    return df.withColumn("segment", out.otherwise(rest))
