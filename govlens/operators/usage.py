"""Query-log analytics and asset value: references, joins, usage types, scores, trend and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights, category floors, multipliers and the number of usage types.
WEIGHTS = {"usage": 0.30, "joins": 0.25, "lineage": 0.25, "data_product": 0.20}
CATEGORIES = (("critical", 80), ("high", 60), ("medium", 40), ("low", 20))
CRITICALITY = {"high": 1.3, "medium": 1.0, "low": 0.7}
RISK = {"high": 1.2, "medium": 1.0, "low": 0.9}
USAGE_TYPES = 12

_NAME = r'["`\[]?[\w.]+["`\]]?'


def _clean(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r'["`\[\]]', ""))


def _spread(log: DataFrame, query: str) -> DataFrame:
    """log with seq, keyword and asset of every table that follows FROM, JOIN, INTO or UPDATE."""
    found = F.regexp_extract_all(F.col(query), F.lit(rf"(?i)\b(from|join|into|update)\s+({_NAME})"), F.lit(0))
    parts = F.split(F.trim("hit"), r"\s+")
    return log.select("*", F.posexplode(found).alias("seq", "hit")).withColumns({"keyword": F.lower(parts[0]), "asset": _clean(parts[1])}).drop("hit")


def references(log: DataFrame, query: str = "query") -> DataFrame:
    """log_id, seq, keyword, asset of every table reference; a regex job over the log, no parser."""
    return _spread(log, query).select("log_id", "seq", "keyword", "asset")


def usages(log: DataFrame) -> DataFrame:
    """log columns with asset and usage_type: direct_query, join_source, aggregation, etl_target or etl_source; and the query's hash."""
    q = F.upper(F.trim("query"))
    grouped = q.rlike(r"\bGROUP BY\b") | q.rlike(r"\b(SUM|COUNT|AVG|MIN|MAX)\s*\(")
    kind = (
        F.when(q.startswith("INSERT"), F.when(F.col("keyword") == "into", "etl_target").otherwise("etl_source"))
        .when(q.startswith("UPDATE") | q.startswith("DELETE"), "etl_target")
        .when(grouped, "aggregation").when(F.col("seq") == 0, "direct_query").otherwise("join_source")
    )
    return _spread(log, "query").select("log_id", "asset", kind.alias("usage_type"), F.substring(F.md5(F.col("query").cast("binary")), 1, 12).alias("query_hash"), "ts", "user", "data_product")


def join_pairs(log: DataFrame) -> DataFrame:
    """left_asset, right_asset, join_type, frequency, data_products of "A ... JOIN B"; the first table of the query is the left side."""
    first = _clean(F.regexp_extract("query", rf"(?i)\bfrom\s+({_NAME})", 1))
    joins = F.regexp_extract_all("query", F.lit(rf"(?i)(?:(?:left|right|full|inner|cross)\s+(?:outer\s+)?)?join\s+{_NAME}"), F.lit(0))
    each = log.select("data_product", first.alias("left_asset"), F.explode(joins).alias("j"))
    kind = F.coalesce(F.nullif(F.upper(F.regexp_extract("j", r"(?i)^(left|right|full|inner|cross)", 1)), F.lit("")), F.lit("INNER"))
    pairs = each.select("left_asset", _clean(F.regexp_extract("j", rf"(?i)join\s+({_NAME})", 1)).alias("right_asset"), kind.alias("join_type"), "data_product")
    return pairs.groupBy("left_asset", "right_asset", "join_type").agg(F.count(F.lit(1)).alias("frequency"), F.sort_array(F.collect_set("data_product")).alias("data_products"))


def join_columns(log: DataFrame) -> DataFrame:
    """log_id, left_column, right_column of every equality of qualified names."""
    found = F.regexp_extract_all("query", F.lit(r"(?i)(\w+\.\w+)\s*=\s*(\w+\.\w+)"), F.lit(0))
    each = log.select("log_id", F.explode(found).alias("eq"))
    return each.select("log_id", F.lower(F.trim(F.split("eq", "=")[0])).alias("left_column"), F.lower(F.trim(F.split("eq", "=")[1])).alias("right_column"))


def _since(reference: str, days: int) -> Column:
    return F.lit(reference).cast("timestamp") - F.make_dt_interval(F.lit(days))


def usage_scores(used: DataFrame, reference: str, days: int = 30, benchmark: int = 1000) -> DataFrame:
    """asset, queries, users, products, types, usage_score of usages within ``days`` of the reference time."""
    own = used.filter(F.col("ts") >= _since(reference, days))
    per = own.groupBy("asset").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("user").alias("users"), F.countDistinct("data_product").alias("products"), F.countDistinct("usage_type").alias("types"))
    base = F.least(F.lit(100.0), F.col("queries") / benchmark * 100)
    spread = F.least(F.lit(1.5), 1 + F.col("users") / 10) * F.least(F.lit(1.3), 1 + F.col("products") / 5)
    return per.withColumn("usage_score", F.least(F.lit(100.0), base * spread * (0.7 + 0.3 * F.col("types") / USAGE_TYPES)))


def join_scores(pairs: DataFrame, benchmark: int = 50) -> DataFrame:
    """asset, joins, frequency, connected, join_score; each relationship counts for both its ends."""
    left = pairs.select(F.col("left_asset").alias("asset"), F.col("right_asset").alias("other"), "frequency", "data_products")
    right = pairs.filter("left_asset <> right_asset").select(F.col("right_asset").alias("asset"), F.col("left_asset").alias("other"), "frequency", "data_products")
    ends = left.unionByName(right)
    per = ends.groupBy("asset").agg(F.count(F.lit(1)).alias("joins"), F.sum("frequency").alias("frequency"), F.countDistinct("other").alias("connected"))
    products = ends.select("asset", F.explode("data_products").alias("p")).groupBy("asset").agg(F.countDistinct("p").alias("products"))
    both = per.join(products, "asset", "left").withColumn("products", F.coalesce("products", F.lit(0)))
    score = F.least(F.lit(100.0), F.col("frequency") / benchmark * 100) * F.least(F.lit(1.5), 1 + F.col("connected") / 20) * F.least(F.lit(1.3), 1 + F.col("products") / 5)
    return both.withColumn("join_score", F.least(F.lit(100.0), score))


def lineage_scores(counts: DataFrame, benchmark: int = 20) -> DataFrame:
    """counts: asset, downstream, upstream, critical; adds lineage_score."""
    score = F.least(F.lit(100.0), F.col("downstream") / benchmark * 100) * F.when(F.col("downstream") > F.col("upstream"), 1.5).otherwise(1.0) * F.when(F.col("critical"), 1.5).otherwise(1.0)
    return counts.withColumn("lineage_score", F.least(F.lit(100.0), score))


def product_impacts(products: DataFrame, used: DataFrame) -> DataFrame:
    """One row per product and asset: usage_types of the asset in the product, ``unknown`` where it was never used."""
    each = products.select("product", "consumers", "revenue_impact", "critical_assets", F.explode("assets").alias("asset"))
    kinds = used.groupBy("asset", F.col("data_product").alias("product")).agg(F.sort_array(F.collect_set("usage_type")).alias("usage_types"))
    out = each.join(kinds, ["asset", "product"], "left")
    return out.select("product", "asset", "consumers", "revenue_impact", F.array_contains("critical_assets", F.col("asset")).alias("critical"), F.coalesce("usage_types", F.array(F.lit("unknown"))).alias("usage_types"))


def product_scores(impacts: DataFrame, benchmark: int = 10) -> DataFrame:
    weight = F.when(F.col("revenue_impact") == "high", 3).when(F.col("revenue_impact") == "medium", 2).when(F.col("revenue_impact") == "low", 1).otherwise(0)
    per = impacts.groupBy("asset").agg(F.count(F.lit(1)).alias("n_products"), F.count_if("critical").alias("critical_paths"), F.sum("consumers").alias("consumers"), F.sum(weight).alias("revenue"))
    score = F.least(F.lit(100.0), F.col("n_products") / benchmark * 100) * (1 + 0.2 * F.col("critical_paths")) * F.least(F.lit(1.5), 1 + F.col("consumers") / 50) * F.least(F.lit(1.5), 1 + F.col("revenue") / 10)
    return per.withColumn("product_score", F.least(F.lit(100.0), score))


def category(score: Column) -> Column:
    out = F.when(score >= CATEGORIES[0][1], CATEGORIES[0][0])
    for name, floor in CATEGORIES[1:]:
        out = out.when(score >= floor, name)
    return out.otherwise("unknown")


def asset_value(parts: list[DataFrame], metadata: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Overall score, category and business impact of all assets that any part (usage, join, lineage, product scores) or metadata names."""
    weights = weights or WEIGHTS
    total = sum(weights.values())
    out = None
    for p in parts:
        own = p.select("asset", *[c for c in p.columns if c.endswith("_score")])
        out = own if out is None else out.join(own, "asset", "full_outer")
    names = {"usage": "usage_score", "joins": "join_score", "lineage": "lineage_score", "data_product": "product_score"}
    out = out.select("asset", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names.values()])
    overall = sum((F.col(c) * (weights[k] / total) for k, c in names.items()), F.lit(0.0))
    out = out.join(metadata, "asset", "left").withColumn("overall", overall)
    crit = F.when(F.col("criticality") == "high", 1.3).when(F.col("criticality") == "low", 0.7).otherwise(1.0)
    risk = F.when(F.col("risk_level") == "high", 1.2).when(F.col("risk_level") == "low", 0.9).otherwise(1.0)
    impact = F.least(F.lit(100.0), F.col("overall") * crit * risk * F.when(F.coalesce("has_pii", F.lit(False)), 1.2).otherwise(1.0) * F.least(F.lit(1.3), 1 + 0.1 * F.coalesce("sla_count", F.lit(0))))
    return out.select("asset", *names.values(), "overall", category(F.col("overall")).alias("category"), impact.alias("business_impact"))


def trend(used: DataFrame, reference: str, days: int = 30) -> DataFrame:
    """asset, recent, older, trend of the recent half of the range against the older one; fewer than two usages are stable."""
    cut, start = _since(reference, days // 2), _since(reference, days)
    per = used.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= cut).alias("recent"), F.count_if((F.col("ts") >= start) & (F.col("ts") < cut)).alias("older"))
    ratio = F.col("recent") / F.col("older")
    kind = F.when(F.col("n") < 2, "stable").when(F.col("older") == 0, F.when(F.col("recent") > 0, "increasing").otherwise("stable")).when(ratio > 1.2, "increasing").when(ratio < 0.8, "decreasing").otherwise("stable")
    return per.select("asset", "recent", "older", kind.alias("trend"))


def report(scored: DataFrame, trends: DataFrame, joined: DataFrame) -> DataFrame:
    """One summary row: assets, mean score, critical, orphan (unknown), declining, hubs (five joins and more), the ten best of 50 and more."""
    all_ = scored.join(trends.select("asset", "trend"), "asset", "left").join(joined.select("asset", "joins"), "asset", "left")
    best = scored.filter("overall >= 50").orderBy(F.desc("overall"), "asset").limit(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("overall")).alias("o"), "asset"))), lambda x: x["asset"]), ",").alias("top"))
    one = all_.agg(F.count(F.lit(1)).alias("assets"), F.avg("overall").alias("mean_score"), F.count_if(F.col("category") == "critical").alias("critical"), F.count_if(F.col("category") == "unknown").alias("orphan"), F.count_if(F.col("trend") == "decreasing").alias("declining"), F.count_if(F.col("joins") >= 5).alias("hubs"))
    return one.join(best)


def merge_heavy(edges: DataFrame, more: int = 5) -> DataFrame:
    """Targets of more than ``more`` merges."""
    return edges.filter("operation = 'MERGE'").groupBy("dst").count().filter(F.col("count") > more)
