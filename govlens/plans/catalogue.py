"""Profile, drift, contract and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.operators import classify, drift, profile
from govlens.sources.tables import read, schema_table


def profile_orders(spark, d):
    out = profile.profile(read(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return out.withColumn("avg_length", F.round("avg_length", 6)).withColumn("null_ratio", F.round("null_ratio", 9)).withColumn("distinct_ratio", F.round("distinct_ratio", 9))


def _profile_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS column_name, count(*) AS total, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, round(avg(length({c}::VARCHAR)), 6) AS avg_length, round((count(*) - count({c})) / count(*), 9) AS null_ratio, round(count(DISTINCT {c}) / count(*), 9) AS distinct_ratio FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


def profile_samples(spark, d):
    return profile.samples(read(spark, d, "part"), "p_brand")


def profile_patterns(spark, d):
    out = profile.pattern_shares(read(spark, d, "pages"), ["url"], {k: profile.VALUE_PATTERNS[k] for k in ("url", "email", "date_iso", "ip_address")})
    return out.withColumn("share", F.round("share", 9))


def semantic_types(spark, d):
    pages = read(spark, d, "pages")
    return profile.semantic_types(schema_table(pages, "pages"), profile.pattern_shares(pages, ["url"]))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _columns(spark, d):
    out = None
    for t in TABLES:
        s = schema_table(read(spark, d, t), t)
        out = s if out is None else out.unionByName(s)
    return out


def name_types(spark, d):
    return _columns(spark, d).select("table_name", "column_name", profile.name_type(F.col("column_name")).alias("semantic_type"))


def domains(spark, d):
    return profile.domains(_columns(spark, d))


def fixed_sample(spark, d):
    return profile.fixed_sample(read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


_COLUMNS = "c AS (SELECT table_name, column_name FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + "))"


def _contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_NAME_CASE = "CASE " + " ".join(f"WHEN {_contains('lower(column_name)', ws)} THEN '{k}'" for k, ws in profile.NAME_HINTS.items()) + " END"
_DOMAIN = f"""WITH {_COLUMNS}, t AS (SELECT table_name, lower(table_name || ' ' || string_agg(column_name, ' ' ORDER BY column_name)) AS text FROM c GROUP BY table_name),
  s AS (SELECT table_name, text, unnest([{', '.join("{'n': " + ' + '.join(f"contains(text, '{w}')::INT" for w in ws) + f", 'o': {-i}, 'd': '{k}'}}" for i, (k, ws) in enumerate(profile.DOMAINS.items()))}]) AS x FROM t)
  SELECT table_name, CASE WHEN max(x.n) > 0 THEN arg_max(x.d, x.n * 100 + x.o) ELSE 'general' END AS domain FROM s GROUP BY table_name"""

# the old schema of orders against a changed one
CHANGED = [
    ("orders", "o_orderkey", "string", True, 0),
    ("orders", "o_customer", "bigint", True, 1),
    ("orders", "o_orderstatus", "string", False, 2),
    ("orders", "o_totalprice", "int", True, 3),
    ("orders", "O_OrderDate", "timestamp", True, 9),
    ("orders", "o_comment", "string", True, 6),
    ("orders", "o_channel", "string", False, 7),
]


def _changed(spark):
    return spark.createDataFrame(CHANGED, "table_name string, column_name string, type string, nullable boolean, position int")


def drift_changes(spark, d):
    return drift.changes(schema_table(read(spark, d, "orders"), "orders"), _changed(spark))


def drift_summary(spark, d):
    return drift.drift_summary(drift_changes(spark, d))


_DRIFT_SQL = """WITH o AS (SELECT column_name, lower(CASE data_type WHEN 'VARCHAR' THEN 'string' ELSE data_type END) AS type, column_index - 1 AS position FROM duckdb_columns() WHERE table_name = 'orders'),
  n(column_name, type, nullable, position) AS (VALUES ('o_orderkey', 'string', true, 0), ('o_customer', 'bigint', true, 1), ('o_orderstatus', 'string', false, 2), ('o_totalprice', 'int', true, 3), ('O_OrderDate', 'timestamp', true, 9), ('o_comment', 'string', true, 6), ('o_channel', 'string', false, 7)),
  gone AS (SELECT * FROM o WHERE column_name NOT IN (SELECT column_name FROM n)), came AS (SELECT * FROM n WHERE column_name NOT IN (SELECT column_name FROM o)),
  r AS (SELECT gone.column_name AS a, came.column_name AS b FROM gone JOIN came ON gone.type = came.type AND (gone.position = came.position OR replace(lower(gone.column_name), '_', '') = replace(lower(came.column_name), '_', '')))
  SELECT 'column_renamed' AS change_type, 'warning' AS severity, a AS column_name, a AS old_value, b AS new_value FROM r
  UNION ALL SELECT 'column_removed', 'critical', column_name, type, NULL FROM gone WHERE column_name NOT IN (SELECT a FROM r)
  UNION ALL SELECT 'column_added', CASE WHEN nullable THEN 'info' ELSE 'warning' END, column_name, NULL, type FROM came WHERE column_name NOT IN (SELECT b FROM r)
  UNION ALL SELECT 'type_changed', CASE WHEN o.column_name = 'o_totalprice' THEN 'critical' ELSE 'warning' END, o.column_name, o.type, n.type FROM o JOIN n USING (column_name) WHERE o.type <> n.type
  UNION ALL SELECT 'nullable_changed', 'critical', column_name, 'true', 'false' FROM n WHERE NOT nullable AND column_name IN (SELECT column_name FROM o)"""

FIELDS = [
    {"name": "o_orderkey", "type": "integer", "required": True, "min": 1},
    {"name": "o_custkey", "type": "string"},
    {"name": "o_totalprice", "type": "float", "max": 300000.0},
    {"name": "o_orderstatus", "type": "string", "regex": "^[FO]$"},
    {"name": "o_region", "type": "string", "required": True},
]
CONTRACT_RULES = [
    {"name": "custkey_unique", "type": "unique", "column": "o_custkey", "severity": "warning", "max_duplicate_pct": 0.5},
    {"name": "status_allowed", "type": "allowed_values", "column": "o_orderstatus", "severity": "critical", "values": ["F", "O"]},
    {"name": "price_range", "type": "range", "column": "o_totalprice", "severity": "critical", "min": 900.0, "max": 450000.0},
    {"name": "priority_form", "type": "regex", "column": "o_orderpriority", "severity": "warning", "regex": "^[1-4]-"},
    {"name": "key_present", "type": "not_null", "column": "o_orderkey", "severity": "critical"},
]


def contract_findings(spark, d):
    out = drift.contract_findings(read(spark, d, "orders"), FIELDS, CONTRACT_RULES)
    return out.withColumn("share", F.round("share", 9))


def contract_verdict(spark, d):
    return drift.verdict(drift.contract_findings(read(spark, d, "orders"), FIELDS, CONTRACT_RULES))


_CONTRACT = """WITH f AS (
  SELECT 'error' AS level, 'missing_column' AS code, 'o_region' AS column_name, 1.0::DOUBLE AS share
  UNION ALL SELECT 'error', 'type_mismatch', 'o_custkey', 1.0
  UNION ALL SELECT 'error', 'required_null', 'o_orderkey', avg((o_orderkey IS NULL)::INT) FROM orders
  UNION ALL SELECT 'warning', 'below_min', 'o_orderkey', avg((o_orderkey < 1)::INT) FROM orders
  UNION ALL SELECT 'warning', 'above_max', 'o_totalprice', avg((o_totalprice > 300000)::INT) FROM orders
  UNION ALL SELECT 'warning', 'regex', 'o_orderstatus', avg((o_orderstatus NOT IN ('F', 'O'))::INT) FROM orders
  UNION ALL SELECT 'warning', 'custkey_unique', 'o_custkey', CASE WHEN 1 - count(DISTINCT o_custkey) / count(*) > 0.5 THEN 1 - count(DISTINCT o_custkey) / count(*) ELSE 0 END FROM orders
  UNION ALL SELECT 'error', 'status_allowed', 'o_orderstatus', avg((o_orderstatus NOT IN ('F', 'O'))::INT) FROM orders
  UNION ALL SELECT 'error', 'price_range', 'o_totalprice', avg((o_totalprice < 900 OR o_totalprice > 450000)::INT) FROM orders
  UNION ALL SELECT 'warning', 'priority_form', 'o_orderpriority', avg((NOT regexp_matches(o_orderpriority, '^[1-4]-'))::INT) FROM orders
  UNION ALL SELECT 'error', 'key_present', 'o_orderkey', avg((o_orderkey IS NULL)::INT) FROM orders)"""

CLASSIFIED = ["c_name", "c_mktsegment", "c_acctbal"]


def classify_columns(spark, d):
    return classify.classify_columns(classify.value_rates(read(spark, d, "customer"), CLASSIFIED)).withColumn("confidence", F.round("confidence", 9))


def classify_table(spark, d):
    return classify.classify_table(classify.classify_columns(classify.value_rates(read(spark, d, "customer"), CLASSIFIED)))


def document_patterns(spark, d):
    out = classify.value_rates(read(spark, d, "documents"), ["text"], terms=["license", "idiot"])
    return out.filter(F.col("pattern").isin("ssn", "email", "ip_address", "mac_address", "license", "idiot")).withColumn("rate", F.round("rate", 9))


def _classify_sql() -> str:
    rates = []
    for col in CLASSIFIED:
        for c, ps in classify.PATTERNS.items():
            rates += [f"SELECT '{col}' AS column_name, '{c}' AS category, avg(regexp_matches({col}::VARCHAR, '(?i){p}')::INT) AS rate FROM customer" for p in ps.values()]
    named = ", ".join(f"CASE WHEN {_contains('column_name', ws)} THEN '{c}' END" for c, ws in classify.HINTS.items())
    return f"""WITH r AS ({' UNION ALL '.join(rates)}),
      p AS (SELECT column_name, list(DISTINCT category) FILTER (rate > 0.1) AS v, coalesce(max(least(1, 0.5 + 0.5 * rate)) FILTER (rate > 0.1), 0) AS m FROM r GROUP BY column_name),
      n AS (SELECT *, list_filter([{named}], lambda x: x IS NOT NULL) AS h FROM p),
      k AS (SELECT column_name, list_sort(list_distinct(list_concat(coalesce(v, []), h))) AS categories,
        CASE WHEN m > 0 AND len(h) > 0 THEN least(1, m + 0.15) ELSE greatest(m, CASE WHEN len(h) > 0 THEN 0.3 ELSE 0 END) END AS confidence FROM n),
      o AS (SELECT *, CASE WHEN len(categories) = 0 THEN 'public' WHEN list_contains(categories, 'phi') THEN 'restricted' WHEN list_contains(categories, 'pii') AND confidence > 0.7 THEN 'restricted'
        WHEN list_contains(categories, 'pii') OR list_contains(categories, 'financial') THEN 'confidential' ELSE 'internal' END AS sensitivity FROM k)"""


QUERIES = {
    "profile_orders": profile_orders,
    "profile_samples": profile_samples,
    "profile_patterns": profile_patterns,
    "profile_semantic_types": semantic_types,
    "profile_name_types": name_types,
    "profile_domains": domains,
    "profile_fixed_sample": fixed_sample,
    "drift_changes": drift_changes,
    "drift_summary": drift_summary,
    "contract_findings": contract_findings,
    "contract_verdict": contract_verdict,
    "classify_columns": classify_columns,
    "classify_table": classify_table,
    "classify_document_patterns": document_patterns,
}

ORACLE = {
    "profile_fixed_sample": "SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 50",
    "profile_orders": _profile_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    "profile_samples": "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand LIMIT 10",
    "profile_patterns": " UNION ALL ".join(
        f"SELECT 'url' AS column_name, '{k}' AS pattern, round(avg(regexp_matches(url, '(?i){profile.VALUE_PATTERNS[k]}')::INT), 9) AS share, avg(regexp_matches(url, '(?i){profile.VALUE_PATTERNS[k]}')::INT) >= 0.5 AS present FROM pages" for k in ("url", "email", "date_iso", "ip_address")
    ),
    "profile_semantic_types": "SELECT unnest(['page_id', 'url', 'html']) AS column_name, unnest(['id', 'url', NULL]) AS semantic_type",
    "profile_name_types": f"WITH {_COLUMNS} SELECT table_name, column_name, {_NAME_CASE} AS semantic_type FROM c",
    "profile_domains": _DOMAIN,
    "drift_changes": _DRIFT_SQL,
    "drift_summary": f"WITH x AS ({_DRIFT_SQL}), y AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM x) SELECT *, 'BREAKING CHANGES: ' || critical || ' critical, ' || warning || ' warnings, ' || info || ' info' AS summary FROM y",
    "contract_findings": f"{_CONTRACT} SELECT level, code, column_name, round(share, 9) AS share FROM f WHERE share > 0",
    "contract_verdict": f"{_CONTRACT}, g AS (SELECT count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM f WHERE share > 0) SELECT *, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'warning' ELSE 'passed' END AS status FROM g",
    "classify_columns": f"{_classify_sql()} SELECT column_name, categories, round(confidence, 9) AS confidence, sensitivity FROM o",
    "classify_table": f"""{_classify_sql()} SELECT count(*) AS columns, ['public', 'internal', 'confidential', 'restricted'][max(list_position(['public', 'internal', 'confidential', 'restricted'], sensitivity))] AS sensitivity,
      count(*) FILTER (sensitivity = 'restricted') AS high_risk, max(list_contains(categories, 'pii')) AS has_pii, max(list_contains(categories, 'phi')) AS has_phi, max(list_contains(categories, 'financial')) AS has_financial FROM o""",
    "classify_document_patterns": " UNION ALL ".join(
        f"SELECT 'text' AS column_name, '{c}' AS category, '{k}' AS pattern, round(avg(regexp_matches(text, '(?i){p}')::INT), 9) AS rate FROM documents"
        for c, k, p in [("pii", k, classify.PATTERNS["pii"][k]) for k in ("ssn", "email", "ip_address", "mac_address")] + [("proprietary", t, rf"\b{t}\b") for t in ("license", "idiot")]
    ),
}
