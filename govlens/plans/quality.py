"""Quality, source and alert queries over the driver's tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.operators import quality as q
from govlens.sources.tables import read, recent

REFERENCE_TIME = "2024-01-31 00:00:00"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """customer with blanks and nulls put in by key."""
    key = F.col("c_custkey")
    return read(spark, d, "customer").select(
        "c_custkey",
        F.when(key % 10 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(key % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(key % 13 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


_CUSTOMERS = """c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '  ' ELSE c_name END AS c_name,
    CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"""


def completeness(spark, d):
    return q.completeness(_customers(spark, d))


_COMPLETENESS = f"""WITH {_CUSTOMERS},
  m AS (SELECT 'c_custkey' AS column_name, count(*) AS total_rows, count(*) FILTER (c_custkey IS NULL) AS null_count FROM c
    UNION ALL SELECT 'c_name', count(*), count(*) FILTER (c_name IS NULL OR trim(c_name) = '') FROM c
    UNION ALL SELECT 'c_acctbal', count(*), count(*) FILTER (c_acctbal IS NULL OR isnan(c_acctbal)) FROM c
    UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (c_mktsegment IS NULL OR trim(c_mktsegment) = '') FROM c),
  a AS (SELECT * FROM m UNION ALL SELECT '*', sum(total_rows)::BIGINT, sum(null_count)::BIGINT FROM m),
  v AS (SELECT *, 1 - null_count / total_rows AS completeness FROM a)
  SELECT *, CASE WHEN completeness >= 0.95 THEN 'passed' WHEN completeness >= 0.95 * 0.9 THEN 'warning' ELSE 'failed' END AS status FROM v"""


def worst_columns(spark, d):
    return q.worst_columns(completeness(spark, d), 2)


def uniqueness_column(spark, d):
    return q.uniqueness(read(spark, d, "orders"), column="o_custkey")


def uniqueness_key(spark, d):
    return q.uniqueness(read(spark, d, "lineitem"), key=["l_orderkey", "l_linenumber"])


def uniqueness_rows(spark, d):
    return q.uniqueness(read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"))


def _unique_sql(rows: str, distinct: str, source: str) -> str:
    return f"""WITH g AS (SELECT {rows} AS total_rows, {distinct} AS distinct_count FROM {source}),
      v AS (SELECT total_rows, distinct_count, total_rows - distinct_count AS duplicate_count, distinct_count / total_rows AS uniqueness FROM g)
      SELECT *, CASE WHEN uniqueness >= 1.0 THEN 'passed' WHEN uniqueness >= 0.95 THEN 'warning' ELSE 'failed' END AS status FROM v"""


def duplicate_groups(spark, d):
    return q.duplicates(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"]).withColumnRenamed("count", "n")


def validity(spark, d):
    pages, orders = read(spark, d, "pages"), read(spark, d, "orders")
    return q.validity(pages, [("url", {"pattern": q.PATTERNS["url"]})]).unionByName(
        q.validity(orders, [("o_orderstatus", {"allowed": ["F", "O"]}), ("o_totalprice", {"low": 1000.0, "high": 300000.0}), ("o_orderpriority", {"pattern": r"^[1-3]-.*$"})])
    )


_VALID = """SELECT *, CASE WHEN validity >= 0.95 THEN 'passed' WHEN validity >= 0.95 * 0.9 THEN 'warning' ELSE 'failed' END AS status FROM (
  SELECT *, valid / checked AS validity FROM (
   SELECT 'url' AS column_name, count(url) AS checked, count(*) FILTER (regexp_matches(url, '(?i)^https?://[^\\s]+$')) AS valid,
     count(url) - count(*) FILTER (regexp_matches(url, '(?i)^https?://[^\\s]+$')) AS pattern, 0 AS not_numeric, 0 AS below_min, 0 AS above_max, 0 AS not_allowed FROM pages
   UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(*) FILTER (o_orderstatus IN ('F', 'O')), 0, 0, 0, 0, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
   UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(*) FILTER (o_totalprice BETWEEN 1000 AND 300000), 0, 0, count(*) FILTER (o_totalprice < 1000), count(*) FILTER (o_totalprice > 300000), 0 FROM orders
   UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(*) FILTER (regexp_matches(o_orderpriority, '^[1-3]-.*$')), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-.*$')), 0, 0, 0, 0 FROM orders))"""


def invalid_samples(spark, d):
    return q.invalid_samples(read(spark, d, "orders"), "o_totalprice", "o_orderkey", low=1000.0, high=300000.0)


def consistency(spark, d):
    c = _customers(spark, d)
    orders = read(spark, d, "orders")
    shifted = orders.select(F.when(F.col("o_orderkey") % 20 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("k"))
    rows = [
        q.not_null_if(c, F.col("c_acctbal") > 0, "c_mktsegment").withColumn("rule", F.lit("not_null_if")),
        q.equals_if(read(spark, d, "lineitem"), F.col("l_linestatus") == "F", "l_returnflag", "l_linestatus").withColumn("rule", F.lit("equals_if")),
        q.referential(shifted, "k", read(spark, d, "customer"), "c_custkey").withColumn("rule", F.lit("referential")),
    ]
    return q.report(rows)


_CONSISTENCY = f"""WITH {_CUSTOMERS}, r AS (
  SELECT 'not_null_if' AS rule, count(*) FILTER (c_acctbal > 0) AS applicable, count(*) FILTER (c_acctbal > 0 AND c_mktsegment IS NULL) AS violations FROM c
  UNION ALL SELECT 'equals_if', count(*) FILTER (l_linestatus = 'F'), count(*) FILTER (l_linestatus = 'F' AND l_returnflag IS DISTINCT FROM l_linestatus) FROM lineitem
  UNION ALL SELECT 'referential', count(*), count(*) FILTER (NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k))
    FROM (SELECT CASE WHEN o_orderkey % 20 = 0 THEN -o_custkey ELSE o_custkey END AS k FROM orders) o)
  SELECT *, CASE WHEN applicable > 0 THEN 1 - violations / applicable ELSE 1.0 END AS consistency FROM r"""


def freshness(spark, d):
    out = q.freshness(read(spark, d, "events"), "ts", REFERENCE_TIME, max_age_hours=24, sla_hours=48)
    return out.select("rows", "latest", "oldest", F.round("age_hours", 6).alias("age_hours"), F.round("freshness", 6).alias("freshness"), "sla_met", F.round("stale_share", 6).alias("stale_share"), "status")


_FRESHNESS = """WITH a AS (SELECT count(ts) AS rows, max(ts) AS latest, min(ts) AS oldest,
    count(*) FILTER ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9 > 24) AS stale FROM events),
  b AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(latest)) / 3.6e9 AS age FROM a),
  c AS (SELECT *, CASE WHEN age <= 48 THEN 1.0 WHEN age <= 96 THEN 1 - (age - 48) / 48 ELSE greatest(0.0, 1 - age / 192) END AS f FROM b)
  SELECT rows, latest, oldest, round(age, 6) AS age_hours, round(f, 6) AS freshness, age <= 48 AS sla_met, round(stale / rows, 6) AS stale_share,
    CASE WHEN age <= 48 AND f >= 0.9 THEN 'passed' WHEN age <= 72 THEN 'warning' ELSE 'failed' END AS status FROM c"""


def quality_report(spark, d):
    """Metric rows of orders: completeness, uniqueness, validity, freshness, references."""
    return q.evaluate(
        read(spark, d, "orders"), unique="o_orderkey", checks=[("o_orderstatus", {"allowed": ["F", "O", "P"]})], references=[("o_custkey", read(spark, d, "customer"), "c_custkey")],
        fresh={"column": "o_orderdate", "reference": "1998-08-02 00:00:00", "max_age_hours": 24, "sla_hours": 72},
    )


_REPORT = """WITH m AS (
  SELECT 'completeness' AS dimension, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority', '*']) AS column_name, 1.0::DOUBLE AS value, 0.95::DOUBLE AS threshold, 'passed' AS status
  UNION ALL SELECT 'uniqueness', 'o_orderkey', u, 1.0, CASE WHEN u >= 1 THEN 'passed' WHEN u >= 0.95 THEN 'warning' ELSE 'failed' END FROM (SELECT count(DISTINCT o_orderkey) / count(*) AS u FROM orders)
  UNION ALL SELECT 'validity', 'o_orderstatus', u, 0.95, CASE WHEN u >= 0.95 THEN 'passed' WHEN u >= 0.95 * 0.9 THEN 'warning' ELSE 'failed' END FROM (SELECT count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) / count(o_orderstatus) AS u FROM orders)
  UNION ALL SELECT 'consistency', 'o_custkey', u, 1.0, CASE WHEN u >= 1 THEN 'passed' WHEN u >= 0.9 THEN 'warning' ELSE 'failed' END
    FROM (SELECT count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) / count(*) AS u FROM orders)
  UNION ALL SELECT 'freshness', 'o_orderdate', round(f, 6), 0.9, CASE WHEN age <= 72 AND f >= 0.9 THEN 'passed' WHEN age <= 108 THEN 'warning' ELSE 'failed' END
    FROM (SELECT age, CASE WHEN age <= 72 THEN 1.0 WHEN age <= 144 THEN 1 - (age - 72) / 72 ELSE greatest(0.0, 1 - age / 288) END AS f
          FROM (SELECT (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(max(o_orderdate))) / 3.6e9 AS age FROM orders)))
  SELECT * FROM m"""


def _metrics(spark, d) -> DataFrame:
    c = _customers(spark, d)
    m = q.report([q.as_metric(q.completeness(c), "completeness", None, "completeness", 0.95), q.as_metric(q.uniqueness(c, column="c_mktsegment"), "uniqueness", "c_mktsegment", "uniqueness", 1.0)])
    return m


def dimension_scores(spark, d):
    return q.dimension_scores(_metrics(spark, d)).withColumn("score", F.round("score", 9))


def metric_summary(spark, d):
    return q.summary(_metrics(spark, d)).withColumn("score", F.round("score", 9))


_METRICS = f"""{_COMPLETENESS.split('SELECT *, CASE WHEN completeness')[0].rstrip()},
  s AS (SELECT count(DISTINCT c_mktsegment) / count(*) AS u FROM c),
  m2 AS (SELECT 'completeness' AS dimension, column_name, completeness AS value, CASE WHEN completeness >= 0.95 THEN 'passed' WHEN completeness >= 0.95 * 0.9 THEN 'warning' ELSE 'failed' END AS status FROM v
    UNION ALL SELECT 'uniqueness', 'c_mktsegment', u, CASE WHEN u >= 1 THEN 'passed' WHEN u >= 0.95 THEN 'warning' ELSE 'failed' END FROM s)"""
_RANKED = "max(CASE status WHEN 'failed' THEN 3 WHEN 'warning' THEN 2 WHEN 'passed' THEN 1 ELSE 0 END)"
_NAMED = f"CASE {_RANKED} WHEN 3 THEN 'failed' WHEN 2 THEN 'warning' WHEN 1 THEN 'passed' ELSE 'skipped' END"

RULES = [
    ("r1", "customer", "completeness", None, 0.99, "warning", True),
    ("r2", "customer", "completeness", "c_acctbal", 0.9, "critical", True),
    ("r3", "customer", "uniqueness", "c_mktsegment", 0.5, "info", True),
    ("r4", "customer", "completeness", "c_name", 0.99, "critical", False),
    ("r5", "customer", "validity", None, 0.99, "critical", True),
    ("r6", "customer", "completeness", "c_custkey", 1.0, "critical", True),
]
RULE = "rule string, table_name string, dimension string, column_name string, threshold double, level string, enabled boolean"


def quality_alerts(spark, d):
    m = _metrics(spark, d).withColumn("seq", F.concat_ws(":", "dimension", "column_name"))
    return q.alerts(spark.createDataFrame(RULES, RULE), m)


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS {names}"


def default_rules(spark, d):
    from govlens.sources.tables import schema_table

    columns = schema_table(read(spark, d, "orders"), "orders").unionByName(schema_table(read(spark, d, "supplier"), "supplier"))
    return q.default_rules(columns.withColumn("column_name", F.lower("column_name")))


def recent_orders(spark, d):
    return recent(read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "1998-01-01", 100, "o_orderkey")


def row_counts(spark, d):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    return q.report([read(spark, d, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names])


QUERIES = {
    "quality_report": quality_report,
    "quality_completeness": completeness,
    "quality_worst_columns": worst_columns,
    "quality_uniqueness_column": uniqueness_column,
    "quality_uniqueness_key": uniqueness_key,
    "quality_uniqueness_rows": uniqueness_rows,
    "quality_duplicate_groups": duplicate_groups,
    "quality_validity": validity,
    "quality_invalid_samples": invalid_samples,
    "quality_consistency": consistency,
    "quality_freshness": freshness,
    "quality_dimension_scores": dimension_scores,
    "quality_metric_summary": metric_summary,
    "quality_alerts": quality_alerts,
    "quality_default_rules": default_rules,
    "source_recent_rows": recent_orders,
    "source_row_counts": row_counts,
}

ORACLE = {
    "quality_report": _REPORT,
    "quality_completeness": _COMPLETENESS,
    "quality_worst_columns": f"SELECT * FROM ({_COMPLETENESS}) WHERE column_name <> '*' ORDER BY completeness, column_name LIMIT 2",
    "quality_uniqueness_column": """WITH v AS (SELECT count(*) AS total_rows, count(DISTINCT o_custkey) AS distinct_count, count(o_custkey) - count(DISTINCT o_custkey) AS duplicate_count FROM orders)
      SELECT *, distinct_count / total_rows AS uniqueness, CASE WHEN distinct_count / total_rows >= 1 THEN 'passed' WHEN distinct_count / total_rows >= 0.95 THEN 'warning' ELSE 'failed' END AS status FROM v""",
    "quality_uniqueness_key": _unique_sql("count(*)", "count(DISTINCT (l_orderkey, l_linenumber))", "lineitem"),
    "quality_uniqueness_rows": _unique_sql("count(*)", "count(DISTINCT (l_partkey, l_suppkey, l_quantity))", "lineitem"),
    "quality_duplicate_groups": "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_partkey, l_suppkey LIMIT 10",
    "quality_validity": _VALID,
    "quality_invalid_samples": """SELECT o_orderkey, left(CAST(o_totalprice AS VARCHAR), 50) AS value, CASE WHEN o_totalprice < 1000 THEN 'below_min' ELSE 'above_max' END AS reason
      FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 300000 ORDER BY o_orderkey LIMIT 10""",
    "quality_consistency": _CONSISTENCY,
    "quality_freshness": _FRESHNESS,
    "quality_dimension_scores": f"{_METRICS} SELECT dimension, count(*) AS checks, round(avg(value), 9) AS score, {_NAMED} AS worst_status FROM m2 GROUP BY dimension",
    "quality_metric_summary": f"{_METRICS} SELECT count(*) AS checks, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, round(avg(value), 9) AS score, {_NAMED} AS worst_status FROM m2",
    "quality_alerts": f"""{_METRICS}, r AS (SELECT * FROM {_values(RULES, 'r(rule, table_name, dimension, column_name, threshold, level, enabled)')}),
      j AS (SELECT r.*, m2.column_name AS c2, m2.value, row_number() OVER (PARTITION BY rule ORDER BY m2.dimension || ':' || m2.column_name) AS k
            FROM r JOIN m2 ON r.dimension = m2.dimension AND (r.column_name IS NULL OR r.column_name = m2.column_name) WHERE enabled)
      SELECT rule, table_name, level, c2 AS column_name, value, threshold, dimension || ' below threshold on ' || table_name AS message FROM j WHERE k = 1 AND value < threshold""",
    "quality_default_rules": """WITH c AS (SELECT table_name, lower(column_name) AS column_name FROM (
        SELECT 'orders' AS table_name, unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name
        UNION ALL SELECT 'supplier', unnest(['s_suppkey','s_name','s_nationkey','s_acctbal'])))
      SELECT table_name, column_name, 'completeness' AS dimension, 0.95::DOUBLE AS threshold, 'warning' AS level FROM c
      UNION ALL SELECT table_name, column_name, 'uniqueness', 1.0, 'critical' FROM c WHERE contains(column_name, 'id') OR column_name LIKE '%\\_key' ESCAPE '\\'""",
    "source_recent_rows": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "source_row_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]),
}
