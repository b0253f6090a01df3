"""Queries of table findings, snapshots of data, cuts of graph measures, titles of components, task patterns, records and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions.scratch import scratch
from govlens.operators import drift, graph, links, metadata, profile, workflow
from govlens.plans.catalogue import TABLES, _columns
from govlens.plans.extras import _described, _keyword_sql
from govlens.plans.lineage import _BOTH, _DAG, _nodes, both, dag
from govlens.plans.quality import _customers, _CUSTOMERS
from govlens.sources import tables as src
from govlens.sources.tables import read

_IN = ", ".join(f"'{t}'" for t in TABLES)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def column_labels(spark, d):
    return metadata.column_labels(metadata.keyword_classes(_described(spark, d))).withColumn("confidence", F.round("confidence", 6))


def _chosen(values: dict) -> str:
    parts = ", ".join(f"CASE WHEN list_contains(categories, '{k}') THEN {_list(v)} ELSE []::VARCHAR[] END" for k, v in values.items())
    return f"list_sort(list_distinct(flatten([{parts}])))"


def _one(values: dict) -> dict:
    return {k: [v] for k, v in values.items()}


_LABELS = f"""{_keyword_sql()}, g AS (SELECT table_name, column_name, list_sort(list(DISTINCT category)) AS categories, least(max(score), 1.0) AS s FROM k GROUP BY ALL)
  SELECT table_name, column_name, categories, round(s, 6) AS confidence, {_chosen(_one(metadata.LABELS))} AS labels, {_chosen(_one(metadata.LAW))} AS law,
    CASE WHEN list_contains(categories, 'PHI') OR list_contains(categories, 'FINANCIAL') OR s >= 0.45 THEN 'high' ELSE 'medium' END AS risk FROM g"""


def table_findings(spark, d):
    classes = metadata.keyword_classes(_described(spark, d))
    notes = _columns(spark, d).select("table_name").distinct().select(
        "table_name", F.when(F.col("table_name") == "orders", "Financial records").when(F.col("table_name") == "events", "health PII").alias("description"),
        F.when(F.col("table_name") == "customer", F.array(F.lit("PII"), F.lit("pci"))).alias("tags"),
    )
    return metadata.table_findings(metadata.table_levels(classes, _columns(spark, d)), notes)


_FINDINGS = f"""{_keyword_sql()}, g AS (SELECT c.table_name, coalesce(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), []) AS categories FROM (SELECT DISTINCT table_name FROM c) c LEFT JOIN k USING (table_name) GROUP BY 1),
  l AS (SELECT *, CASE WHEN len(categories) = 0 THEN 'LOW' WHEN list_contains(categories, 'PHI') THEN 'CRITICAL' WHEN list_contains(categories, 'FINANCIAL') THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM g)
  SELECT table_name, level, categories, {_chosen(metadata.CONTROLS)} AS controls, CASE level {' '.join(f"WHEN '{k}' THEN {_list(v)}" for k, v in metadata.ACTIONS.items())} END AS actions,
    list_filter([CASE WHEN table_name = 'events' THEN 'description: PII' END, CASE WHEN table_name = 'events' THEN 'description: PHI' END, CASE WHEN table_name = 'orders' THEN 'description: FINANCIAL' END,
      CASE WHEN table_name = 'customer' THEN 'tag: pii' END, CASE WHEN table_name = 'customer' THEN 'tag: financial/pci' END, CASE WHEN len(categories) > 0 THEN 'columns: ' || array_to_string(categories, ', ') END], lambda x: x IS NOT NULL) AS reasons,
    CASE WHEN level IN ('CRITICAL', 'HIGH') THEN 'high' WHEN level = 'MEDIUM' THEN 'medium' ELSE 'none' END AS risk, CASE level {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in metadata.CLASSES.items())} END AS recommended FROM l"""


def data_snapshot(spark, d):
    return drift.data_snapshot(_customers(spark, d), "customer").select("table_name", "column_name", "nullable", "position")


_SNAPSHOT = f"""WITH {_CUSTOMERS} SELECT 'customer' AS table_name, unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']) AS column_name,
  unnest([count(*) > count(c_custkey), count(*) > count(c_name), count(*) > count(c_acctbal), count(*) > count(c_mktsegment)]) AS nullable, unnest([0, 1, 2, 3]) AS position FROM c"""


def _history(spark, d):
    return read(spark, d, "lineitem").selectExpr("'t' || (l_partkey % 40) AS table_name", "l_orderkey * 10 + l_linenumber AS version", "'h' || (l_suppkey % 7) AS hash")


def snapshot_history(spark, d):
    return drift.newest(_history(spark, d), 3)


def snapshot_statistics(spark, d):
    return drift.snapshot_statistics(_history(spark, d))


_HISTORY = "h AS (SELECT 't' || (l_partkey % 40) AS table_name, l_orderkey * 10 + l_linenumber AS version, 'h' || (l_suppkey % 7) AS hash FROM lineitem)"


def table_class(spark, d):
    c = _customers(spark, d)
    p = profile.profile(c, c.columns)
    return profile.table_class(p, p.select("column_name", (F.col("column_name") == "c_name").alias("is_pii")).filter("column_name <> 'c_custkey'"))


_CLASS = f"SELECT column_name, column_name = 'c_name' AS is_pii, nullable, 'restricted' AS table_class FROM ({_SNAPSHOT})"


def compared_assets(spark, d):
    scored = read(spark, d, "part").selectExpr("p_partkey AS asset", "p_retailprice AS score")
    return workflow.compared(scored, [1, 5, 9, 12, 40], "asset", "score").withColumn("behind", F.round("behind", 6))


def compared_initiatives(spark, d):
    scored = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("initiative")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return workflow.compared(scored, [1, 2, 4, 7, 10, 11, 13], "initiative", "score").withColumn("behind", F.round("behind", 2))


def text_forms(spark, d):
    return read(spark, d, "part").select("p_partkey", metadata.text_form(F.col("p_name"), F.col("p_type"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))).alias("text"))


def flat_records(spark, d):
    p = read(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.split("p_type", " ")).alias("tags"), F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("extra")
    )
    return metadata.flat_records(p)


def _typed(spark, d):
    e = both(spark, d)
    return _nodes(e).withColumn("type", F.when(F.col("id").contains(":"), F.substring_index("id", ":", 1)).otherwise("event")), e


def dominant_types(spark, d):
    return graph.dominant_types(*_typed(spark, d)).withColumn("share", F.round("share", 9))


def component_titles(spark, d):
    n, e = _typed(spark, d)
    return graph.component_titles(n, e)


def central_nodes(spark, d):
    b = graph.betweenness(dag(spark, d)).select("id", F.round("score", 6).alias("score"))
    return graph.above(b, "score", 0.9).withColumn("limit", F.round("limit", 6))


def dense_spots(spark, d):
    n, e = _typed(spark, d)
    found = graph.dense_spots(n, e)
    return found.select("id", "degree", F.round("coefficient", 9).alias("coefficient"), F.round("limit", 9).alias("limit"))


def price_percentile(spark, d):
    return graph.percentile(read(spark, d, "orders"), "o_totalprice", 0.9).withColumn("limit", F.round("limit", 4))


def task_patterns(spark, d):
    tasks = read(spark, d, "lineitem").selectExpr(
        "l_orderkey % 300 AS dag", "element_at(array('extract_a', 'clean', 'load_c', 'quality', 'tell', 'wait', 'split'), l_linenumber) AS task",
        "element_at(array('Bash', 'PythonOperator', 'Bash', 'Sql', 'SlackOperator', IF(l_suppkey % 3 = 0, 'ExternalTaskSensor', 'FileSensor'), 'BranchOperator'), l_linenumber) AS operator",
        "int(l_quantity) % 4 AS retries", "'d' || (l_partkey % 5) AS external_dag",
    )
    return workflow.task_patterns(tasks)


_PATTERNS = """WITH t AS (SELECT l_orderkey % 300 AS dag, l_linenumber AS n, l_suppkey % 3 = 0 AS x, floor(l_quantity)::INT % 4 AS r, 'd' || (l_partkey % 5) AS e FROM lineitem)
  SELECT dag, bool_or(n = 1) AND bool_or(n = 2) AND bool_or(n = 3) AS etl, count(*) FILTER (n = 4) AS checks, count(*) FILTER (n = 5) AS notifies, count(*) FILTER (n = 6) AS sensors, count(*) FILTER (n = 7) AS branches,
    count(*) FILTER (r > 0) AS retries, count(*) FILTER (n = 6 AND x) AS cross_dag, coalesce(list_sort(list(DISTINCT e) FILTER (n = 6 AND x)), []) AS waits_for FROM t GROUP BY 1"""


def partitioned_inventory(spark, d):
    """Folders, files, rows and keys of a table written by order status, and whether the scan knows its bytes."""
    path = scratch(spark, "by-status")
    read(spark, d, "orders").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    out = src.inventory(spark.read.parquet(path))
    return out.select(F.regexp_extract("folder", "[^/]*$", 0).alias("folder"), "files", "rows", F.col("partition_keys"), (F.col("bytes") > 0).alias("has_bytes"))


def exported_log(spark, d):
    """The log of a span of days, written as JSON lines and read back."""
    log = read(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    days = links.log_rows(log, "event_id", since="2024-01-05 00:00:00", until="2024-01-12 00:00:00", limit=None)
    return src.write_report(days, scratch(spark, "audit"))


def exported_metadata(spark, d):
    """The catalog's columns, written as JSON lines and read back, a record a table."""
    c = _columns(spark, d)
    per = c.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name", "type"))), lambda x: F.struct(x["column_name"].alias("name"), x["type"].alias("type"))).alias("columns"))
    back = src.write_report(per, scratch(spark, "metadata"))
    return back.select("table_name", F.inline("columns"))


QUERIES = {
    "schema_column_labels": column_labels, "schema_table_findings": table_findings, "drift_data_snapshot": data_snapshot, "drift_snapshot_history": snapshot_history, "drift_snapshot_statistics": snapshot_statistics,
    "profile_table_class": table_class, "value_compared_assets": compared_assets, "portfolio_compared_initiatives": compared_initiatives, "catalog_text_forms": text_forms, "catalog_flat_records": flat_records,
    "lineage_dominant_types": dominant_types, "lineage_component_titles": component_titles, "lineage_central_nodes": central_nodes, "lineage_dense_spots": dense_spots, "lineage_percentile": price_percentile, "lineage_task_patterns": task_patterns,
    "source_partitioned_inventory": partitioned_inventory, "audit_exported_log": exported_log, "catalog_exported_metadata": exported_metadata,
}

_WORDS = lambda m: "CASE " + " ".join(f"WHEN max(contains(lower(id), '{w}')) THEN '{v}'" for w, v in m.items())
_BETWEEN = f"""WITH RECURSIVE {_DAG}, p(s, v, w, d) AS (SELECT DISTINCT src, src, 1::DOUBLE, 0 FROM dag UNION ALL SELECT p.s, dag.dst, sum(p.w), max(p.d) + 1 FROM p JOIN dag ON dag.src = p.v GROUP BY p.s, dag.dst),
  b AS (SELECT m.v AS id, round(sum(m.w * x.w / t.w), 6) AS score FROM p m JOIN p x ON x.s = m.v AND x.d > 0 JOIN p t ON t.s = m.s AND t.v = x.v WHERE m.d > 0 GROUP BY m.v)"""

ORACLE = {
    "schema_column_labels": _LABELS,
    "schema_table_findings": _FINDINGS,
    "drift_data_snapshot": _SNAPSHOT,
    "drift_snapshot_history": f"WITH {_HISTORY} SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY version DESC) <= 3",
    "drift_snapshot_statistics": f"WITH {_HISTORY} SELECT table_name, count(*) AS versions, min(version) AS first_version, max(version) AS last_version, count(DISTINCT hash) AS hashes FROM h GROUP BY 1",
    "profile_table_class": _CLASS,
    "value_compared_assets": "WITH s AS (SELECT p_partkey AS asset, p_retailprice AS score FROM part WHERE p_partkey IN (1, 5, 9, 12, 40)) SELECT asset, score, round((SELECT max(score) FROM s) - score, 6) AS behind FROM s",
    "portfolio_compared_initiatives": "WITH s AS (SELECT o_custkey AS initiative, round(sum(o_totalprice), 2) AS score FROM orders WHERE o_custkey IN (1, 2, 4, 7, 10, 11, 13) GROUP BY 1) SELECT initiative, score, round((SELECT max(score) FROM s) - score, 2) AS behind FROM s",
    "catalog_text_forms": "SELECT p_partkey, p_name || ' (' || p_type || ')' || CASE WHEN p_size % 3 = 0 THEN ' - ' || p_brand ELSE '' END AS text FROM part",
    "catalog_flat_records": """SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name ELSE '' END AS name, CASE WHEN p_size % 2 = 0 THEN replace(p_type, ' ', ', ') ELSE '' END AS tags, '{"size":' || p_size || ',"brand":"' || p_brand || '"}' AS extra FROM part""",
    "lineage_dominant_types": f"""WITH RECURSIVE {_BOTH}, t AS (SELECT component, CASE WHEN contains(id, ':') THEN split_part(id, ':', 1) ELSE 'event' END AS type, count(*) AS n FROM wc GROUP BY ALL), s AS (SELECT component, sum(n)::BIGINT AS size FROM t GROUP BY 1)
      SELECT component, size, type AS dominant_type, round(n / size, 9) AS share FROM t JOIN s USING (component) QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, type) = 1""",
    "lineage_component_titles": f"""WITH RECURSIVE {_BOTH} SELECT component, count(*) AS size, {_WORDS(graph.TITLES)} ELSE 'Component (' || count(*) || ' nodes)' END AS title, {_WORDS(graph.PURPOSES)} ELSE 'Data processing and transformation' END AS purpose FROM wc GROUP BY component""",
    "lineage_central_nodes": f'{_BETWEEN}, q AS (SELECT round(quantile_cont(score, 0.9), 6) AS "limit" FROM b) SELECT id, score, "limit" FROM b, q WHERE score > "limit"',
    "lineage_dense_spots": f"""WITH RECURSIVE {_BOTH}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM al WHERE src <> dst), n AS (SELECT a AS id, b AS o FROM e UNION ALL SELECT b, a FROM e), dd AS (SELECT id, count(*) AS k FROM n GROUP BY id),
      t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), tr AS (SELECT id, count(*) AS triangles FROM (SELECT unnest([p, q, r]) AS id FROM t) GROUP BY id),
      f AS (SELECT ad.id, ad.i + ad.o AS degree, CASE WHEN k > 1 THEN 2 * coalesce(triangles, 0) / (k * (k - 1)) ELSE 0 END AS coefficient FROM ad LEFT JOIN dd USING (id) LEFT JOIN tr USING (id)), q AS (SELECT quantile_cont(coefficient, 0.8) AS cut FROM f)
      SELECT id, degree, round(coefficient, 9) AS coefficient, round(cut, 9) AS "limit" FROM f, q WHERE coefficient > cut AND degree > 5""",
    "lineage_percentile": 'SELECT count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.9), 4) AS "limit" FROM orders',
    "lineage_task_patterns": _PATTERNS,
    "source_partitioned_inventory": "SELECT 'o_orderstatus=' || o_orderstatus AS folder, 1 AS files, count(*) AS rows, ['o_orderstatus'] AS partition_keys, true AS has_bytes FROM orders GROUP BY o_orderstatus",
    "audit_exported_log": "SELECT event_id, user_id, event_type, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'",
    "catalog_exported_metadata": f"SELECT table_name, column_name AS name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type FROM duckdb_columns() WHERE table_name IN ({_IN})",
}
