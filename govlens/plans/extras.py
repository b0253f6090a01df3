"""Further queries: schema keywords, taxonomies, rules, keys, tasks, code, rejoined texts, registry log, complexity, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions.scratch import table
from govlens.operators import graph, metadata
from govlens.plans.catalogue import TABLES, _columns, _contains
from govlens.plans.lineage import _BOTH, _DAG, _nodes, both, dag
from govlens.plans.value import _LOG, log
from govlens.sources import tables as src
from govlens.sources.tables import read


def _described(spark, d):
    c = _columns(spark, d)
    return c.select("table_name", "column_name", "type", F.when(F.col("column_name").endswith("key"), "account key").alias("description"), F.when(F.col("table_name") == "customer", F.array(F.lit("PII"))).alias("tags"))


def keyword_classes(spark, d):
    return metadata.keyword_classes(_described(spark, d)).withColumn("score", F.round("score", 6))


def table_levels(spark, d):
    return metadata.table_levels(metadata.keyword_classes(_described(spark, d)), _columns(spark, d))


def _keyword_sql() -> str:
    rows = []
    for category, weight, words, types, marks in metadata.RULES:
        parts = []
        for w in words:
            named = f"contains(low, '{w}')" if "_" in w else f"list_contains(tokens, '{w}')"
            parts.append(f"CASE WHEN {named} THEN {0.5 * weight} WHEN contains(description, '{w}') THEN {0.35 * weight} ELSE 0 END")
        parts += [f"CASE WHEN contains(type, '{t}') THEN {0.25 * weight} ELSE 0 END" for t in types]
        parts += [f"CASE WHEN '{m}' = 'pii' AND table_name = 'customer' THEN {0.2 * weight} ELSE 0 END" for m in marks]
        rows.append(f"SELECT table_name, column_name, '{category}' AS category, ({' + '.join(parts)})::DOUBLE AS score FROM c")
    return f"""WITH c AS (SELECT table_name, column_name, lower(column_name) AS low, regexp_split_to_array(lower(column_name), '[_\\s]+') AS tokens, CASE WHEN column_name LIKE '%key' THEN 'account key' ELSE '' END AS description,
      CASE data_type WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS type FROM duckdb_columns() WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})),
      k AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE score >= 0.45 - 1e-9)"""


def _concepts(spark, d):
    return read(spark, d, "part").selectExpr("p_brand AS taxonomy", "p_name AS concept", "CASE WHEN p_size % 3 <> 0 THEN p_type END AS definition", "IF(p_size % 4 = 0, array('x'), array()) AS aliases", "IF(p_size % 2 = 0, array('string'), array()) AS types")


def _taxonomies(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("taxonomy")).agg(F.min("p_size").alias("s"), F.max("p_partkey").alias("k")).selectExpr("taxonomy", "s * 2 + 3 AS groups", "s % 4 AS rules", "k % 2 = 0 AS ambiguous", "30 * int(k % 4) AS conventions", "k % 3 = 0 AS datetime", "k % 2 = 1 AS owner", "k % 5 = 0 AS steward", "s % 2 = 0 AS agents", "int(k % 3) AS zones", "k % 7 < 4 AS projects")


def taxonomy_scores(spark, d):
    out = metadata.taxonomy_scores(_taxonomies(spark, d), _concepts(spark, d))
    return out.select("taxonomy", *[F.round(c, 6).alias(c) for c in [*metadata.TAXONOMY, "overall"]], "level")


def taxonomy_gaps(spark, d):
    return metadata.taxonomy_gaps(taxonomy_scores(spark, d))


_TAX = f"""t AS (SELECT p_brand AS taxonomy, min(p_size) AS s, max(p_partkey) AS k, count(*) AS n, count(*) FILTER (p_size % 3 <> 0) AS d, count(*) FILTER (p_size % 4 = 0) AS a, count(*) FILTER (p_size % 2 = 0) AS ty FROM part GROUP BY 1),
  x AS (SELECT taxonomy, (30 * (k % 4))::DOUBLE AS naming, d / n * 100 AS definitions, least(100.0, least(100.0, a / n * 150) + CASE WHEN k % 2 = 0 THEN 20 ELSE 0 END) AS aliases, least(100.0, (s % 4) * 50.0) AS context, least(100.0, (s * 2 + 3) * 10.0) AS structure,
    ty / n * 80 + CASE WHEN k % 3 = 0 THEN 20 ELSE 0 END AS types, (CASE WHEN k % 2 = 1 THEN 30 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 30 ELSE 0 END + CASE WHEN s % 2 = 0 THEN 40 ELSE 0 END)::DOUBLE AS governance, (CASE WHEN k % 3 > 0 THEN 60 ELSE 0 END + CASE WHEN k % 7 < 4 THEN 40 ELSE 0 END)::DOUBLE AS platform FROM t),
  y AS (SELECT *, {' + '.join(f'{k} * {w}' for k, w in metadata.TAXONOMY.items())} AS overall FROM x),
  z AS (SELECT taxonomy, {', '.join(f'round({c}, 6) AS {c}' for c in [*metadata.TAXONOMY, 'overall'])}, CASE WHEN overall < 20 THEN 1 WHEN overall < 40 THEN 2 WHEN overall < 60 THEN 3 WHEN overall < 80 THEN 4 ELSE 5 END AS level FROM y)"""


def drafted_rules(spark, d):
    return metadata.drafted_rules(_columns(spark, d).withColumn("nullable", ~F.col("column_name").endswith("key")))


def inferred_keys(spark, d):
    c = _columns(spark, d).select("table_name", F.regexp_replace(F.regexp_replace("column_name", "^[a-z]_", ""), "key$", "_key").alias("column_name"))
    return metadata.inferred_keys(c)


def task_metrics(spark, d):
    e = read(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("dag"), F.concat(F.lit("t"), F.col("l_suppkey") % 9).alias("src"), F.concat(F.lit("t"), F.col("l_suppkey") % 9 + 1 + F.col("l_partkey") % 3).alias("dst"))
    tasks = e.select("dag", F.col("src").alias("task")).unionByName(e.select("dag", F.col("dst").alias("task")))
    return graph.task_metrics(tasks, e)


_TASKS = """WITH e AS (SELECT DISTINCT l_orderkey % 40 AS dag, 't' || (l_suppkey % 9) AS src, 't' || (l_suppkey % 9 + 1 + l_partkey % 3) AS dst FROM lineitem), t AS (SELECT dag, src AS task FROM e UNION SELECT dag, dst FROM e),
  f AS (SELECT dag, task, (SELECT count(*) FROM e WHERE e.dag = t.dag AND e.dst = t.task) AS i, (SELECT count(*) FROM e WHERE e.dag = t.dag AND e.src = t.task) AS o FROM t),
  w AS (SELECT dag, max(n) AS width FROM (SELECT dag, i, count(*) AS n FROM f GROUP BY ALL) GROUP BY dag)
  SELECT dag, count(*) AS tasks, count(*) FILTER (i > 3 OR o > 3) AS bottlenecks, count(*) FILTER (i = 0) AS sources, count(*) FILTER (o = 0) AS sinks, any_value(width) AS width FROM f JOIN w USING (dag) GROUP BY dag"""


def code_references(spark, d):
    files = read(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("df = spark.table('raw.t"), F.col("o_custkey") % 20, F.lit("')\ndf.write.saveAsTable(\"silver.S"), F.col("o_orderkey") % 7, F.lit("\")\nMERGE INTO gold.g"), F.col("o_custkey") % 3, F.lit(" USING x")).alias("text"))
    return graph.code_references(files)


_CODE = """SELECT o_orderkey AS file, 'read' AS kind, 'raw.t' || (o_custkey % 20) AS name FROM orders UNION ALL SELECT o_orderkey, 'save', 'silver.s' || (o_orderkey % 7) FROM orders UNION ALL SELECT o_orderkey, 'merge', 'gold.g' || (o_custkey % 3) FROM orders"""


def rejoined(spark, d):
    q = log(spark, d).select("log_id", "query")
    pieces = q.select("log_id", F.posexplode(F.split(F.regexp_replace("query", "(.{12})", "$1\u0001"), "\u0001")).alias("seq", "text"))
    return metadata.rejoined(pieces, "log_id", "seq", "text").withColumnRenamed("text", "query")


def session_usage(spark, d):
    return metadata.session_usage(read(spark, d, "events").select((F.col("user_id") % 30).alias("session"), (F.col("event_id") % 100).alias("rows")))


def registry_state(spark, d):
    changes = read(spark, d, "lineitem").selectExpr("l_partkey AS model_id", "CASE l_linenumber % 3 WHEN 0 THEN 'stage' WHEN 1 THEN 'status' ELSE 'owner' END AS kind", "CASE l_linenumber % 3 WHEN 0 THEN IF(l_orderkey % 2 = 0, 'production', 'archived') WHEN 1 THEN IF(l_orderkey % 3 = 0, 'inactive', 'active') ELSE 'team' || (l_suppkey % 5) END AS value", "l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS seq")
    return metadata.changed_state(changes)


_STATE = """WITH c AS (SELECT l_partkey AS model_id, l_linenumber % 3 AS k, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'production' ELSE 'archived' END WHEN 1 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'inactive' ELSE 'active' END ELSE 'team' || (l_suppkey % 5) END AS v, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS seq FROM lineitem),
  s AS (SELECT model_id, arg_max(v, seq) FILTER (k = 0) AS stage, arg_max(v, seq) FILTER (k = 1) AS status, arg_max(v, seq) FILTER (k = 2) AS owner, count(*) AS changes FROM c GROUP BY 1)
  SELECT model_id, stage, CASE WHEN stage = 'archived' THEN 'inactive' ELSE status END AS status, owner, changes FROM s"""


def complexity(spark, d):
    e = table(dag(spark, d), "lineage-edges")
    return graph.complexity(_nodes(e), e).withColumn("density", F.round("density", 9))


def clusters(spark, d):
    return graph.clusters(_nodes(dag(spark, d)))


def component_names(spark, d):
    e = both(spark, d)
    return graph.component_names(_nodes(e), e)


def inventory(spark, d):
    """Rows of each scanned table by the folder of its files."""
    return src.inventory(read(spark, d, "lineitem")).select("files", "rows")


def run_event_round_trip(spark, d):
    """Edges written as JSON lines, one event per job, and read back as edges."""
    import uuid

    from govlens.functions.scratch import shared_dir

    e = dag(spark, d).filter("src like 'supp:%' or src like 'nation:%'")
    events = e.groupBy(F.col("dst").alias("job")).agg(F.sort_array(F.collect_set("src")).alias("inputs")).select(F.lit("COMPLETE").alias("event_type"), "job", "inputs", F.array(F.concat(F.col("job"), F.lit("!"))).alias("outputs"))
    path = f"{shared_dir(spark)}/run-events-{uuid.uuid4().hex}"
    events.write.json(path)
    return graph.event_edges(src.run_events(spark, path, "event_type string, job string, inputs array<string>, outputs array<string>"))


QUERIES = {
    "schema_keyword_classes": keyword_classes, "schema_table_levels": table_levels, "taxonomy_scores": taxonomy_scores, "taxonomy_gaps": taxonomy_gaps, "govern_drafted_rules": drafted_rules, "schema_inferred_keys": inferred_keys,
    "lineage_task_metrics": task_metrics, "lineage_code_references": code_references, "source_rejoined_queries": rejoined, "audit_session_usage": session_usage, "registry_state": registry_state, "lineage_complexity": complexity,
    "lineage_clusters": clusters, "lineage_component_names": component_names, "source_inventory": inventory, "lineage_run_event_round_trip": run_event_round_trip,
}

ORACLE = {
    "schema_keyword_classes": f"{_keyword_sql()} SELECT table_name, column_name, category, round(score, 6) AS score FROM k",
    "schema_table_levels": f"""{_keyword_sql()}, g AS (SELECT c.table_name, coalesce(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), []) AS categories FROM (SELECT DISTINCT table_name FROM c) c LEFT JOIN k USING (table_name) GROUP BY 1)
      SELECT *, CASE WHEN len(categories) = 0 THEN 'LOW' WHEN list_contains(categories, 'PHI') THEN 'CRITICAL' WHEN list_contains(categories, 'FINANCIAL') THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM g""",
    "taxonomy_scores": f"WITH {_TAX} SELECT * FROM z",
    "taxonomy_gaps": f"""WITH {_TAX}, u AS ({' UNION ALL '.join(f"SELECT taxonomy, '{k}' AS dimension, {k} AS score FROM z" for k in metadata.TAXONOMY)})
      SELECT *, CASE WHEN score < 20 THEN 'critical' WHEN score < 50 THEN 'major' ELSE 'minor' END AS severity, row_number() OVER (PARTITION BY taxonomy ORDER BY score, dimension) AS priority FROM u WHERE score < 80""",
    "govern_drafted_rules": f"""WITH c AS (SELECT table_name, column_name FROM duckdb_columns() WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)}))
      SELECT table_name, column_name, 'completeness' AS dimension, 'high' AS severity FROM c WHERE column_name LIKE '%key' UNION ALL
      SELECT table_name, column_name, 'uniqueness', CASE WHEN {_contains('column_name', ['cpf', 'cnpj', 'email'])} THEN 'critical' ELSE 'high' END FROM c WHERE {_contains('column_name', ['_id', 'id_', 'cpf', 'cnpj', 'email', 'code', 'codigo'])}""",
    "schema_inferred_keys": f"""WITH c AS (SELECT table_name, regexp_replace(regexp_replace(column_name, '^[a-z]_', ''), 'key$', '_key') AS column_name FROM duckdb_columns() WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})),
      k AS (SELECT DISTINCT column_name, coalesce(nullif(regexp_extract(column_name, '^(.+)_id$', 1), ''), nullif(regexp_extract(column_name, '^(.+)_key$', 1), ''), nullif(regexp_extract(column_name, '^id_(.+)$', 1), '')) AS entity FROM c)
      SELECT column_name, entity, referenced FROM k JOIN (SELECT DISTINCT table_name AS referenced FROM c) ON contains(referenced, entity) WHERE entity IS NOT NULL""",
    "lineage_task_metrics": _TASKS,
    "lineage_code_references": _CODE,
    "source_rejoined_queries": f"WITH {_LOG} SELECT log_id, query FROM log",
    "audit_session_usage": "SELECT user_id % 30 AS session, count(*) AS queries, sum(event_id % 100)::BIGINT AS rows_read FROM events GROUP BY 1",
    "registry_state": _STATE,
    "lineage_clusters": f"WITH {_DAG} SELECT split_part(id, ':', 1) AS cluster, count(*) AS nodes FROM dn GROUP BY 1",
    "lineage_component_names": f"""WITH RECURSIVE {_BOTH}, x AS (SELECT component, min(id) AS a, max(id) AS z FROM wc GROUP BY component)
      SELECT component, substr(a, 1, list_max(list_filter(range(0, least(length(a), length(z)) + 1), lambda k: substr(a, 1, k) = substr(z, 1, k)))) AS prefix FROM x""",
    "lineage_complexity": f"""WITH RECURSIVE {_BOTH}, x AS (SELECT (SELECT count(*) FROM dn) AS nodes, (SELECT count(*) FROM dag) AS edges, (SELECT count(*) FROM dg WHERE in_degree = 0) AS so, (SELECT count(*) FROM dg WHERE out_degree = 0) AS si,
        (SELECT count(DISTINCT component) FROM wc JOIN dn USING (id)) AS components), y AS (SELECT *, edges / (nodes * (nodes - 1)) AS density FROM x),
      z AS (SELECT *, CASE WHEN nodes > 100 THEN 3 WHEN nodes > 50 THEN 2 WHEN nodes > 20 THEN 1 ELSE 0 END + CASE WHEN density > 0.3 THEN 2 WHEN density > 0.15 THEN 1 ELSE 0 END + CASE WHEN components > 3 THEN 1 ELSE 0 END AS points,
        CASE WHEN so > 1 OR si > 1 THEN 30 ELSE 10 END + CASE WHEN density < 0.1 THEN 40 WHEN density < 0.2 THEN 20 ELSE 0 END + CASE WHEN components > 1 THEN 20 ELSE 0 END AS share FROM y)
      SELECT nodes, round(density, 9) AS density, false AS cyclic, components, CASE WHEN points >= 6 THEN 'very high' WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'moderate' ELSE 'low' END AS band, least(share, 90) AS parallel_percent FROM z""",
    "source_inventory": "SELECT 1 AS files, count(*) AS rows FROM lineitem",
    "lineage_run_event_round_trip": f"""WITH {_DAG}, e AS (SELECT src, dst FROM dag WHERE src LIKE 'supp:%' OR src LIKE 'nation:%') SELECT DISTINCT src, dst, 'READ' AS operation FROM e UNION ALL SELECT DISTINCT dst, dst || '!', 'WRITE' FROM e""",
}
