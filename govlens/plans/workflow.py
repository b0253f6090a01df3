"""Queries of the smaller governance steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.operators import entities, links, workflow as w
from govlens.plans.catalogue import TABLES, _columns
from govlens.plans.discovery import _SCORED, _hybrid
from govlens.sources.tables import read
from govlens.streaming import quality as stream

_C = f"c AS (SELECT table_name, column_name, column_index - 1 AS position, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type FROM duckdb_columns() WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)}))"


def catalog_search(spark, d):
    return w.search_names(_columns(spark, d).select("table_name", "column_name"), "column_name", "KEY")


def naming_violations(spark, d):
    names = _columns(spark, d).select(F.lit("column").alias("scope"), F.col("column_name").alias("name"))
    rules = spark.createDataFrame([("column", "prefix", "^[a-z]_[a-z]+$", ["type"]), ("column", "short", "^.{1,12}$", []), ("table", "other", "^x$", [])], "scope string, rule string, pattern string, forbidden array<string>")
    return w.naming_violations(names, rules)


def merged_labels(spark, d):
    p = read(spark, d, "part")
    a = p.selectExpr("p_name AS column_name", "IF(p_size % 2 = 0, array('pii'), array('financial')) AS categories", "p_size / 50 AS confidence", "p_partkey").filter("p_partkey % 3 <> 0")
    b = p.selectExpr("p_name AS column_name", "array('pii', 'phi') AS categories", "0.5D AS confidence", "p_partkey").filter("p_partkey % 2 = 0")
    key = lambda x: x.withColumn("column_name", F.concat_ws("#", "column_name", F.col("p_partkey").cast("string")))
    out = w.merge_labels(key(a), key(b))
    return out.select("column_name", "categories", F.round("confidence", 6).alias("confidence"), w.law_classes(F.col("categories")).alias("law"))


_MERGED = """WITH p AS (SELECT p_name || '#' || p_partkey AS column_name, p_size, p_partkey FROM part), m AS (SELECT column_name, list_sort(list_distinct(list_concat(CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN ['pii'] ELSE ['financial'] END ELSE [] END, CASE WHEN p_partkey % 2 = 0 THEN ['pii', 'phi'] ELSE [] END))) AS categories,
  greatest(CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50 ELSE 0 END, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END) AS confidence FROM p WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0)
  SELECT column_name, categories, round(confidence, 6) AS confidence, list_filter([CASE WHEN list_contains(categories, 'pii') THEN 'personal data' END, CASE WHEN list_contains(categories, 'phi') THEN 'sensitive personal data' END, CASE WHEN list_contains(categories, 'financial') THEN 'financial data' END], lambda x: x IS NOT NULL) AS law FROM m"""


def term_conflicts(spark, d):
    new = read(spark, d, "part").select(F.col("p_type").alias("term"))
    known = read(spark, d, "part").selectExpr("IF(p_size % 2 = 0, lower(p_type), substring(p_type, 1, 5)) AS term", "p_size % 4 = 0 AS deprecated")
    return w.term_conflicts(new, known)


_CONFLICTS = """WITH a AS (SELECT DISTINCT p_type AS term, lower(trim(p_type)) AS x FROM part), b AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE substr(p_type, 1, 5) END AS known_term, p_size % 4 = 0 AS deprecated FROM part), c AS (SELECT *, lower(trim(known_term)) AS y FROM b)
  SELECT term, known_term, 'exact' AS kind FROM a JOIN c ON x = y AND NOT deprecated UNION ALL SELECT term, known_term, 'contains' FROM a JOIN c ON x <> y AND least(length(x), length(y)) > 3 AND (contains(x, y) OR contains(y, x))"""


def impacted_rules(spark, d):
    rules = read(spark, d, "part").selectExpr("p_partkey AS rule", "p_brand AS dataset", "'a' || (p_partkey % 50) AS attribute")
    changes = read(spark, d, "supplier").selectExpr("s_suppkey AS change", "'Brand#' || (s_suppkey % 30) AS dataset", "'a' || (s_suppkey % 60) AS attribute")
    return w.impacted_rules(rules, changes)


_IMPACTED = """SELECT DISTINCT p_partkey AS rule, s_suppkey AS change FROM part, supplier WHERE p_brand = 'Brand#' || (s_suppkey % 30) OR 'a' || (p_partkey % 50) = 'a' || (s_suppkey % 60)"""


def reference_types(spark, d):
    u = F.col("url")
    space, name = w.split_name(F.regexp_replace(u, r"^\w+://", ""), "default")
    return read(spark, d, "pages").select("page_id", w.dataset_type(u).alias("kind"), w.reference_type(u).alias("protocol"), space.alias("namespace"), name.alias("name"))


_REFERENCES = """WITH p AS (SELECT page_id, url, regexp_replace(url, '^\\w+://', '') AS r FROM pages)
  SELECT page_id, 'api' AS kind, split_part(url, '://', 1) AS protocol, CASE WHEN contains(r, '/') THEN split_part(r, '/', 1) ELSE regexp_extract(r, '^(.*)\\.[^.]*$', 1) END AS namespace, CASE WHEN contains(r, '/') THEN regexp_extract(r, '^[^/]*/(.*)$', 1) ELSE regexp_extract(r, '[^.]*$') END AS name FROM p"""


def table_text(spark, d):
    return w.table_text(_columns(spark, d))


def escalated(spark, d):
    issues = read(spark, d, "customer").selectExpr("c_custkey AS issue_id", "'ds' || (c_custkey % 30) AS dataset", "CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity")
    quality = read(spark, d, "nation").selectExpr("'ds' || n_nationkey AS dataset", "IF(n_nationkey % 2 = 0, 'failed', 'passed') AS status")
    classes = read(spark, d, "nation").selectExpr("'ds' || n_nationkey AS dataset", "IF(n_nationkey % 5 = 0, 'restricted', 'public') AS level")
    return w.escalate(issues, quality, classes)


_ESCALATED = """WITH i AS (SELECT c_custkey AS issue_id, c_custkey % 30 AS k, CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity FROM customer)
  SELECT issue_id, 'ds' || k AS dataset, CASE WHEN k < 25 AND k % 5 = 0 THEN 'critical' WHEN k < 25 AND k % 2 = 0 AND severity IN ('low', 'medium') THEN 'high' ELSE severity END AS severity FROM i"""


def _people(spark, d):
    return read(spark, d, "supplier").selectExpr("'d' || (s_suppkey % 12) AS domain", "s_name AS person", "IF(s_suppkey % 3 = 0, 'owner', 'steward') AS role", "s_suppkey % 4 <> 0 AS active")


def approvers(spark, d):
    return w.approvers(_people(spark, d))


_APPROVERS = """SELECT 'd' || (s_suppkey % 12) AS domain, list(s_name ORDER BY s_suppkey % 3 <> 0, s_name) AS approvers FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1"""


def pending(spark, d):
    requests = read(spark, d, "orders").selectExpr("o_orderkey AS request_id", "array('u' || (o_custkey % 9), 'u' || (o_custkey % 4)) AS approvers")
    decided = read(spark, d, "lineitem").filter("l_returnflag = 'R'").selectExpr("l_orderkey AS request_id")
    return w.pending(requests, decided, "u3").select("request_id")


def task_flags(spark, d):
    tasks = read(spark, d, "lineitem").selectExpr("l_orderkey % 200 AS dag", "CASE l_linenumber WHEN 1 THEN 'extract_a' WHEN 2 THEN 'transform_b' WHEN 3 THEN 'load_c' WHEN 4 THEN 'quality_check' WHEN 5 THEN 'notify' WHEN 6 THEN 'wait_sensor' ELSE 'branch' END AS task", "int(l_quantity) % 17 AS retries")
    return w.task_flags(tasks)


_FLAGS = """SELECT l_orderkey % 200 AS dag, max(l_linenumber = 1) AND max(l_linenumber = 2) AND max(l_linenumber = 3) AS etl, max(l_linenumber = 4) AS checks, max(l_linenumber = 5) AS notifies, max(l_linenumber = 6) AS waits, max(l_linenumber > 6 OR l_linenumber < 1) AS branches, max(floor(l_quantity)::INT % 17 > 0) AS retries FROM lineitem GROUP BY 1"""


def task_edges(spark, d):
    tasks = read(spark, d, "part").selectExpr("'t' || (p_partkey % 300) AS task", "array('t' || (p_partkey % 300 - 1)) AS depends_on", "array(p_brand) AS inputs", "array('out' || (p_size % 9)) AS outputs")
    return w.task_edges(tasks)


_TASK_EDGES = """SELECT DISTINCT 't' || (p_partkey % 300 - 1) AS src, 't' || (p_partkey % 300) AS dst, 'dependency' AS kind FROM part UNION SELECT p_brand, 't' || (p_partkey % 300), 'input' FROM part UNION SELECT 't' || (p_partkey % 300), 'out' || (p_size % 9), 'output' FROM part"""


def confidence(spark, d):
    ranked, e = _hybrid(spark, d)
    known = e.select("vec_id", F.when(F.col("label") % 2 == 0, F.lit("yes")).alias("match"))
    out = w.discovery_confidence(ranked, known, "query_id", "vec_id")
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("mean_score", "rate", "confidence")])


def guided_plan(spark, d):
    tables = read(spark, d, "part").selectExpr("p_brand AS domain", "'t' || lpad(string(p_partkey), 8, '0') AS name", "p_size % 5 AS maturity", "p_size % 7 = 0 AS private", "double(p_partkey % 60) AS hours")
    return w.guided_plan(tables)


_PLAN = """SELECT p_brand AS domain, coalesce(list('t' || lpad(p_partkey::VARCHAR, 8, '0') ORDER BY lpad(p_partkey::VARCHAR, 8, '0')) FILTER (p_size % 5 >= 3), []) AS first, coalesce(list('t' || lpad(p_partkey::VARCHAR, 8, '0') ORDER BY lpad(p_partkey::VARCHAR, 8, '0')) FILTER (p_size % 5 < 3), []) AS later,
  count(*) FILTER (p_size % 7 = 0) AS private, count(*) FILTER (p_partkey % 60 > 24) AS stale, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 4 THEN 'medium' ELSE 'low' END AS effort FROM part GROUP BY 1"""


def cost_totals(spark, d):
    df = read(spark, d, "part").selectExpr("p_partkey AS initiative", "p_retailprice AS a", "IF(p_size % 3 = 0, NULL, double(p_size)) AS b", "p_retailprice / 2 AS c", "double(p_size) AS o")
    out = w.cost_totals(df, {"development": ["a", "b"], "infrastructure": ["c"], "operational": ["o"]})
    return out.select("initiative", *[F.round(x, 4).alias(x) for x in ("development_total", "infrastructure_total", "operational_total", "initial", "year_one")])


_COSTS = """WITH x AS (SELECT p_partkey AS initiative, p_retailprice + CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS dv, p_retailprice / 2 AS inf, p_size::DOUBLE AS op FROM part)
  SELECT initiative, round(dv, 4) AS development_total, round(inf, 4) AS infrastructure_total, round(op, 4) AS operational_total, round(dv + inf, 4) AS initial, round(dv + inf + op, 4) AS year_one FROM x"""


def concerned_teams(spark, d):
    return _columns(spark, d).select("table_name", "column_name", links.teams_of(F.concat_ws(" ", "table_name", "column_name")).alias("teams"))


_TEAMS = f"""WITH {_C}, l AS (SELECT table_name, column_name, table_name || ' ' || lower(column_name) AS x FROM c) SELECT table_name, column_name, list_filter([{', '.join("CASE WHEN " + ' OR '.join(f"contains(x, '{k}')" for k in ws) + f" THEN '{t}' END" for t, ws in links.TEAMS.items())}], lambda v: v IS NOT NULL) AS teams FROM l"""


def stream_guardrail(spark, d):
    """The guardrail's redaction on a stream of prompts."""
    path = f"{d}/conversations.parquet"
    keep = [p for p in entities.PATTERNS if p[0] in ("email", "ip_address")]
    plan = lambda s: s.filter("role = 'user'").select("conv_id", "turn", entities.redact(F.col("text"), keep).alias("sent"))
    return stream.run_to_table(spark, path, spark.read.parquet(path).schema, plan, "stream-guardrail", mode="append")


def runtime_denials(spark, d):
    prompts = read(spark, d, "documents").selectExpr("doc_id", "text", "IF(doc_id % 2 = 0, 'external_llm', 'internal') AS provider")
    return w.runtime_denials(prompts, entities.spans(prompts, "doc_id"), "doc_id")


def suggested_dimensions(spark, d):
    return w.suggested_dimensions(_columns(spark, d))


def evidence(spark, d):
    requests = read(spark, d, "orders").selectExpr("o_orderkey AS request_id", "'d' || (o_custkey % 40) AS dataset")
    quality = read(spark, d, "nation").selectExpr("'d' || n_nationkey AS dataset", "n_nationkey / 25 AS score")
    classes = read(spark, d, "supplier").filter("s_suppkey < 30").selectExpr("'d' || s_suppkey AS dataset", "IF(s_suppkey % 2 = 0, 'internal', 'public') AS level")
    return w.evidence(requests, quality, classes).withColumn("score", F.round("score", 6))


def flat_concepts(spark, d):
    each = read(spark, d, "part").select(F.col("p_brand").alias("taxonomy"), "p_type", F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array()).alias("aliases")).alias("c"))
    return w.flat_concepts(each.groupBy("taxonomy", "p_type").agg(F.collect_list("c").alias("concepts")))


def snippets(spark, d):
    ranked, _ = _hybrid(spark, d)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return w.snippets(ranked.filter("rank <= 5"), docs, "vec_id").select("query_id", "vec_id", "rank", "snippet")


def scoring_snapshot(spark, d):
    """The projection that a scoring job reads."""
    return read(spark, d, "customer").select(F.col("c_custkey").alias("subscriber"), F.col("c_mktsegment").alias("plan"), F.round(F.col("c_acctbal") / 10000, 6).alias("score"), (F.col("c_acctbal") < 0).alias("at_risk"))


QUERIES = {
    "policy_runtime_denials": runtime_denials, "govern_suggested_dimensions": suggested_dimensions, "govern_evidence": evidence, "taxonomy_flat_concepts": flat_concepts, "discovery_snippets": snippets, "etl_scoring_snapshot": scoring_snapshot,
    "catalog_search": catalog_search, "catalog_naming_violations": naming_violations, "classify_merged_labels": merged_labels, "govern_term_conflicts": term_conflicts, "govern_impacted_rules": impacted_rules, "lineage_reference_types": reference_types,
    "catalog_table_text": table_text, "govern_escalated": escalated, "govern_approvers": approvers, "govern_pending": pending, "lineage_task_flags": task_flags, "lineage_task_edges": task_edges, "discovery_confidence": confidence,
    "discovery_guided_plan": guided_plan, "portfolio_cost_totals": cost_totals, "govern_concerned_teams": concerned_teams, "stream_guardrail": stream_guardrail,
}

ORACLE = {
    "discovery_snippets": f"WITH {_SCORED} SELECT query_id, vec_id, rank, substr(text, 1, 300) AS snippet FROM rk JOIN documents ON doc_id = vec_id WHERE rank <= 5",
    "discovery_confidence": f"""WITH {_SCORED}, k AS (SELECT query_id, avg(score) AS s, avg(CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.0 END) AS r FROM rk JOIN embeddings USING (vec_id) WHERE rank <= 5 GROUP BY 1)
      SELECT query_id, round(s, 6) AS mean_score, round(r, 6) AS rate, round(0.7 * s + 0.3 * r, 6) AS confidence FROM k""",
    "govern_suggested_dimensions": f"""WITH {_C}, k AS (SELECT table_name, unnest(['completeness', CASE WHEN contains(lower(column_name), 'id') OR ends_with(lower(column_name), 'key') THEN 'uniqueness' END, CASE WHEN contains(lower(column_name), 'date') OR contains(lower(column_name), 'ts') THEN 'freshness' END,
      CASE WHEN contains(lower(column_name), 'status') OR contains(lower(column_name), 'type') THEN 'validity' END]) AS dimension FROM c) SELECT table_name, list_sort(list(DISTINCT dimension)) AS dimensions FROM k WHERE dimension IS NOT NULL GROUP BY 1""",
    "govern_evidence": """SELECT o_orderkey AS request_id, 'd' || (o_custkey % 40) AS dataset, round(n_nationkey / 25, 6) AS score, CASE WHEN s_suppkey % 2 = 0 THEN 'internal' WHEN s_suppkey IS NOT NULL THEN 'public' END AS level, n_nationkey IS NOT NULL AND s_suppkey IS NOT NULL AS complete
      FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40 LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 30) ON s_suppkey = o_custkey % 40""",
    "taxonomy_flat_concepts": "SELECT p_brand AS taxonomy, count(*) AS concepts, sum(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS aliases FROM part GROUP BY 1",
    "etl_scoring_snapshot": "SELECT c_custkey AS subscriber, c_mktsegment AS plan, round(c_acctbal / 10000, 6) AS score, c_acctbal < 0 AS at_risk FROM customer",
    "catalog_search": f"WITH {_C} SELECT table_name, column_name FROM c WHERE contains(lower(column_name), 'key') ORDER BY column_name, table_name LIMIT 20",
    "catalog_naming_violations": f"WITH {_C} SELECT 'column' AS scope, column_name AS name, 'prefix' AS rule FROM c WHERE NOT regexp_matches(column_name, '^[a-z]_[a-z]+$') OR contains(lower(column_name), 'type') UNION ALL SELECT 'column', column_name, 'short' FROM c WHERE length(column_name) > 12",
    "classify_merged_labels": _MERGED,
    "govern_term_conflicts": _CONFLICTS,
    "govern_impacted_rules": _IMPACTED,
    "lineage_reference_types": _REFERENCES,
    "catalog_table_text": f"WITH {_C} SELECT table_name, string_agg(column_name || ' ' || type, ', ' ORDER BY position) AS text FROM c GROUP BY 1",
    "govern_escalated": _ESCALATED,
    "govern_approvers": _APPROVERS,
    "govern_pending": "SELECT o_orderkey AS request_id FROM orders WHERE (o_custkey % 9 = 3 OR o_custkey % 4 = 3) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "lineage_task_flags": _FLAGS,
    "lineage_task_edges": _TASK_EDGES,
    "discovery_guided_plan": _PLAN,
    "portfolio_cost_totals": _COSTS,
    "govern_concerned_teams": _TEAMS,
    "stream_guardrail": """SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?i)\\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}\\b', '[PII]', 'g'), '(?i)\\b(?:(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)\\.){3}(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)\\b', '[PII]', 'g') AS sent FROM conversations WHERE role = 'user'""",
}
