"""Policy, triage, ownership, registry and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.operators import governance as g
from govlens.plans.value import _LOG, log
from govlens.sources.tables import read

_EVENT = [
    "o_orderkey AS event_id",
    "CASE o_orderkey % 4 WHEN 0 THEN 'registry.transition' WHEN 1 THEN 'cicd.deploy' WHEN 2 THEN 'train.start' ELSE 'inference.request' END AS event",
    "CASE WHEN o_custkey % 2 = 0 THEN 'prod' ELSE 'staging' END AS next_stage",
    "CASE WHEN o_custkey % 3 = 0 THEN 'pending' WHEN o_custkey % 3 = 1 THEN 'approved' END AS risk_status",
    "CASE o_custkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_tier",
    "CASE WHEN o_custkey % 4 < 3 THEN 'prod' ELSE 'staging' END AS env",
    "CASE WHEN o_custkey % 9 <> 0 THEN 0.7 + (o_custkey % 30) / 100 END AS auc",
    "0.6 + (o_custkey % 20) / 100 AS robustness",
    "CASE WHEN o_custkey % 7 < 4 THEN 'complete' ELSE 'open' END AS lgpd",
    "CASE WHEN o_custkey % 6 <> 5 THEN o_custkey % 3 = 0 END AS contains_pii",
    "CASE WHEN o_custkey % 2 = 0 THEN 'external_llm' ELSE 'internal' END AS provider",
]
_POLICY = f"""ev AS (SELECT {', '.join(e.replace('0.7 + (', '0.7::DOUBLE + (').replace('0.6 + (', '0.6::DOUBLE + (') for e in _EVENT)} FROM orders), dec AS (
  SELECT event_id, 'gate-risk-approved' AS policy, CASE WHEN event <> 'registry.transition' OR next_stage <> 'prod' THEN 'not_applicable' WHEN risk_status = 'approved' AND risk_tier IN ('low', 'medium') THEN 'allow' ELSE 'block' END AS decision FROM ev
  UNION ALL SELECT event_id, 'gate-validation-baseline', CASE WHEN event <> 'cicd.deploy' OR env <> 'prod' THEN 'not_applicable' WHEN auc >= 0.85::DOUBLE AND robustness >= 0.70::DOUBLE THEN 'allow' ELSE 'block' END FROM ev
  UNION ALL SELECT event_id, 'gate-compliance-lgpd', CASE WHEN event NOT IN ('train.start', 'registry.transition') THEN 'not_applicable' WHEN lgpd = 'complete' AND NOT coalesce(contains_pii, false) THEN 'allow' ELSE 'block' END FROM ev
  UNION ALL SELECT event_id, 'runtime-no-external-llm-with-pii', CASE WHEN event <> 'inference.request' OR provider <> 'external_llm' THEN 'not_applicable' WHEN coalesce(contains_pii, false) THEN 'deny' ELSE 'allow' END FROM ev)"""


def _events(spark, d):
    return read(spark, d, "orders").selectExpr(*[e.replace("0.7 +", "0.7D +").replace("0.6 +", "0.6D +") for e in _EVENT])


def policy_decisions(spark, d):
    return g.decisions(_events(spark, d))


def policy_exceptions(spark, d):
    ex = read(spark, d, "orders").filter("o_orderkey % 3 = 0").selectExpr("o_orderkey AS event_id", "'gate-compliance-lgpd' AS policy", "CASE o_custkey % 3 WHEN 0 THEN 'DPO' WHEN 1 THEN 'CISO' ELSE 'CTO' END AS approver", "date_add(date'1998-08-02', -int(o_custkey % 60)) AS granted")
    return g.excused(g.decisions(_events(spark, d)), ex, "1998-08-02")


def triage(spark, d):
    return g.triage(read(spark, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "title", "category", "severity", "sla_hours")


def _pick(words: dict, default: str) -> str:
    counts = {k: " + ".join(f"contains(low, '{w}')::INT" for w in ws) for k, ws in words.items()}
    best = "greatest(" + ", ".join(f"({c})" for c in counts.values()) + ")"
    return f"CASE WHEN {best} = 0 THEN '{default}' " + " ".join(f"WHEN ({c}) = {best} THEN '{k}'" for k, c in counts.items()) + " END"


_TRIAGE = f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM conversations),
  x AS (SELECT conv_id, turn, left(regexp_extract(trim(text, ' '), '^[^\\n]*'), 80) AS title, {_pick(g.CATEGORY_KEYWORDS, 'quality')} AS category, {_pick(g.SEVERITY_KEYWORDS, 'medium')} AS severity FROM t)
  SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 24 WHEN 'medium' THEN 72 ELSE 168 END AS sla_hours FROM x"""


def owner_suggestions(spark, d):
    issues = read(spark, d, "customer").selectExpr("c_custkey AS issue_id", "c_mktsegment AS domain", "'ds' || (c_custkey % 40) AS dataset")
    people = read(spark, d, "supplier").selectExpr("CASE s_suppkey % 6 WHEN 0 THEN 'building' WHEN 1 THEN 'MACHINERY' END AS domain", "array('ds' || (s_suppkey % 60), 'ds' || (s_suppkey % 7)) AS datasets", "CASE WHEN s_suppkey % 2 = 0 THEN 'owner' ELSE 'steward' END AS role", "s_name AS person", "s_suppkey AS seq", "s_suppkey % 5 <> 0 AS active")
    return g.owners(issues, people)


_OWNERS = """WITH a AS (SELECT CASE s_suppkey % 6 WHEN 0 THEN 'building' WHEN 1 THEN 'MACHINERY' END AS domain, ['ds' || (s_suppkey % 60), 'ds' || (s_suppkey % 7)] AS datasets, CASE WHEN s_suppkey % 2 = 0 THEN 'owner' ELSE 'steward' END AS role, s_name AS person, s_suppkey AS seq FROM supplier WHERE s_suppkey % 5 <> 0),
  i AS (SELECT c_custkey AS issue_id, c_mktsegment AS domain, 'ds' || (c_custkey % 40) AS dataset FROM customer)
  SELECT issue_id, arg_max(person, seq) FILTER (role = 'owner') AS owner, arg_max(person, seq) FILTER (role = 'steward') AS steward FROM i LEFT JOIN a ON lower(i.domain) = lower(a.domain) OR list_contains(a.datasets, i.dataset) GROUP BY issue_id"""


def glossary_conflicts(spark, d):
    terms = read(spark, d, "part").selectExpr("p_brand AS term", "CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE p_type END AS definition", "p_partkey AS source")
    return g.definition_conflicts(terms)


def name_resolution(spark, d):
    catalog = read(spark, d, "nation").selectExpr("'main.' || lower(n_name) || '.facts' AS name").unionByName(read(spark, d, "supplier").selectExpr("'main.sales.' || s_name AS name"))
    found = read(spark, d, "customer").selectExpr("CASE c_custkey % 4 WHEN 0 THEN 'main.sales.Supplier#' || lpad(cast(c_custkey AS string), 9, '0') WHEN 1 THEN 'sales.Supplier#' || lpad(cast(c_custkey AS string), 9, '0') WHEN 2 THEN 'other.Supplier#' || lpad(cast(c_custkey AS string), 9, '0') ELSE IF(c_custkey % 8 = 3, 'facts', 'supplier#0000' || c_custkey) END AS name")
    return g.resolve_names(found, catalog)


_NAMES = """WITH c AS (SELECT lower('main.' || lower(n_name) || '.facts') AS full_name FROM nation UNION SELECT lower('main.sales.' || s_name) FROM supplier),
  f AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'main.sales.Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'sales.Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 2 THEN 'other.Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') ELSE CASE WHEN c_custkey % 8 = 3 THEN 'facts' ELSE 'supplier#0000' || c_custkey END END AS name FROM customer),
  m AS (SELECT name, full_name, CASE WHEN lower(name) = full_name THEN 0 WHEN ends_with(full_name, '.' || lower(name)) THEN 1 WHEN list_last(string_split(lower(name), '.')) = list_last(string_split(full_name, '.')) THEN 2 ELSE 3 END AS kind FROM f JOIN c ON contains(full_name, lower(name)) OR list_last(string_split(lower(name), '.')) = list_last(string_split(full_name, '.'))),
  b AS (SELECT name, full_name, kind, row_number() OVER (PARTITION BY name ORDER BY kind, full_name) AS k FROM m)
  SELECT f.name, full_name AS match, CASE WHEN kind = 0 THEN 'high' WHEN kind < 3 THEN 'medium' WHEN kind = 3 THEN 'low' END AS confidence FROM f LEFT JOIN b ON f.name = b.name AND k = 1"""


def approval_state(spark, d):
    decided = read(spark, d, "lineitem").selectExpr("l_orderkey AS request_id", "CASE l_linenumber % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'submitted' ELSE 'rejected' END AS status", "l_shipdate AS ts", "l_linenumber AS seq")
    return g.current_state(decided)


_MODEL = [
    "p_partkey AS model_id",
    "p_brand AS model_type",
    "CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN 'critical' WHEN 3 THEN 'medium' ELSE 'low' END AS risk_level",
    "CASE WHEN p_partkey % 6 <> 0 THEN 'team' || (p_partkey % 4) END AS owner_team",
    "p_partkey % 8 = 0 AS is_shadow",
]
_STAGE = "CASE ({k}) % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'development' ELSE 'archived' END"
_STATUS = "CASE WHEN ({k}) % 3 = 0 THEN 'inactive' ELSE 'active' END"


def _models(spark, d):
    version = lambda n, k: f"named_struct('version', '{n}', 'stage', {_STAGE.format(k=k)}, 'status', {_STATUS.format(k=k)}, 'promoted', {n[1]})"
    return read(spark, d, "part").selectExpr(*_MODEL, f"array({version('v1', 'p_partkey')}, {version('v2', 'p_partkey + p_size')}) AS versions", "array(IF(p_size % 3 = 0, 'pii', 'none'), IF(p_size % 7 = 0, 'phi', 'none')) AS data_classes", "array('t' || (p_size % 5)) AS tags")


_MODELS = f"""m AS (SELECT {', '.join(_MODEL)}, [{{'version': 'v1', 'stage': {_STAGE.format(k='p_partkey')}, 'status': {_STATUS.format(k='p_partkey')}}}, {{'version': 'v2', 'stage': {_STAGE.format(k='p_partkey + p_size')}, 'status': {_STATUS.format(k='p_partkey + p_size')}}}] AS versions, p_size FROM part),
  mv AS (SELECT model_id, unnest(versions) AS v FROM m)"""


def registry_statistics(spark, d):
    return g.registry_statistics(_models(spark, d))


def registry_search(spark, d):
    return g.find_models(_models(spark, d), stage="production", status="active", risk="high", tag="t1").select("model_id", "model_type")


def registry_production(spark, d):
    return g.production_versions(_models(spark, d))


def registry_compliance(spark, d):
    return g.compliance(_models(spark, d))


def audit_chain(spark, d):
    """A log made of events whose previous_hash is the hash before; rows were altered afterwards, others relinked."""
    own = F.sha2(F.concat_ws("|", "event_id", "user_id", "event_type"), 256)
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", own.alias("event_hash"), F.floor(F.col("event_id") / 500).alias("shard"))
    prev = F.lag("event_hash").over(W.partitionBy("shard").orderBy("event_id"))
    ends = e.groupBy("shard").agg(F.max_by("event_hash", "event_id").alias("end")).select((F.col("shard") + 1).alias("shard"), "end")
    linked = e.withColumn("p", prev).join(ends, "shard", "left").withColumn("previous_hash", F.coalesce("p", "end", F.lit("GENESIS")))
    broken = linked.withColumn("user_id", F.when(F.col("event_id") % 997 == 5, F.col("user_id") + 1).otherwise(F.col("user_id"))).withColumn("previous_hash", F.when(F.col("event_id") % 991 == 7, F.lit("x")).otherwise(F.col("previous_hash")))
    return g.chain_breaks(broken, ["event_id", "user_id", "event_type"], order="event_id")


def latency(spark, d):
    out = g.latency_statistics(read(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), "low", "high", "p95")


def user_activity(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "ts", (F.col("event_id") % 50).alias("session"))
    return g.user_activity(e)


def vault_statistics(spark, d):
    return g.vault_statistics(read(spark, d, "part").select(F.col("p_type").alias("entity_type"), F.col("p_brand").alias("category")))


def query_history(spark, d):
    return g.query_history(log(spark, d), "1996-01-01 00:00:00", user="u3", text="left join", limit=50).select("log_id", "ts", "query")


QUERIES = {
    "policy_decisions": policy_decisions, "policy_exceptions": policy_exceptions, "govern_triage": triage, "govern_owner_suggestions": owner_suggestions, "govern_glossary_conflicts": glossary_conflicts,
    "govern_name_resolution": name_resolution, "govern_approval_state": approval_state, "registry_statistics": registry_statistics, "registry_search": registry_search, "registry_production": registry_production,
    "registry_compliance": registry_compliance, "audit_chain_breaks": audit_chain, "audit_latency": latency, "audit_user_activity": user_activity, "vault_statistics": vault_statistics, "source_query_history": query_history,
}

ORACLE = {
    "policy_decisions": f"WITH {_POLICY} SELECT * FROM dec",
    "policy_exceptions": f"""WITH {_POLICY} SELECT event_id, policy, CASE WHEN decision = 'block' AND policy = 'gate-compliance-lgpd' AND o_orderkey % 3 = 0 AND o_custkey % 3 <> 2 AND o_custkey % 60 <= 30 THEN 'excepted' ELSE decision END AS decision FROM dec JOIN orders ON o_orderkey = event_id""",
    "govern_triage": _TRIAGE,
    "govern_owner_suggestions": _OWNERS,
    "govern_glossary_conflicts": """WITH o AS (SELECT lower(trim(p_brand)) AS term, lower(trim(p_type)) AS d, min(p_partkey) AS source FROM part GROUP BY 1, 2)
      SELECT a.term, a.source AS first_source, b.source AS second_source FROM o a JOIN o b ON a.term = b.term AND a.source < b.source""",
    "govern_name_resolution": _NAMES,
    "govern_approval_state": """WITH l AS (SELECT l_orderkey AS request_id, arg_max(CASE l_linenumber % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'submitted' ELSE 'rejected' END, (l_shipdate, l_linenumber)) AS status, count(*) AS steps FROM lineitem GROUP BY 1)
      SELECT *, CASE status WHEN 'approved' THEN 'active' WHEN 'rejected' THEN 'draft' ELSE 'pending' END AS item_state FROM l""",
    "registry_statistics": f"""WITH {_MODELS}, e AS (SELECT model_id, 'type' AS dimension, model_type AS value FROM m UNION ALL SELECT model_id, 'risk', risk_level FROM m UNION ALL SELECT model_id, 'team', owner_team FROM m UNION ALL SELECT model_id, 'stage', v.stage FROM mv UNION ALL SELECT model_id, 'status', v.status FROM mv)
      SELECT dimension, value, count(DISTINCT model_id) AS n FROM e WHERE value IS NOT NULL GROUP BY ALL""",
    "registry_search": f"WITH {_MODELS} SELECT model_id, model_type FROM m WHERE risk_level = 'high' AND p_size % 5 = 1 AND model_id IN (SELECT model_id FROM mv WHERE v.stage = 'production' AND v.status = 'active')",
    "registry_production": f"WITH {_MODELS} SELECT model_id, max(v.version) AS version FROM mv WHERE v.stage = 'production' AND v.status = 'active' GROUP BY model_id",
    "registry_compliance": f"""WITH {_MODELS}, l AS (SELECT DISTINCT model_id FROM mv WHERE v.stage = 'production') SELECT count(*) FILTER (risk_level IS NULL) AS unassessed, count(*) FILTER (risk_level IN ('high', 'critical') AND model_id IN (SELECT model_id FROM l)) AS high_risk_live,
      count(*) FILTER (is_shadow AND model_id IN (SELECT model_id FROM l)) AS shadow_live, count(*) FILTER (owner_team IS NULL) AS no_owner, count(*) FILTER (p_size % 3 = 0) AS pii, count(*) FILTER (p_size % 7 = 0) AS phi FROM m""",
    "audit_chain_breaks": "SELECT event_id // 500 AS shard, event_id, CASE WHEN event_id % 997 = 5 THEN 'hash' ELSE 'link' END AS fault FROM events WHERE event_id % 997 = 5 OR event_id % 991 = 7",
    "audit_latency": """WITH n AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events WHERE value IS NOT NULL)
      SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, coalesce(max(value) FILTER (n > 20 AND k = floor(0.95 * n)::BIGINT + 1), max(value)) AS p95 FROM n GROUP BY event_type""",
    "audit_user_activity": "SELECT user_id, event_type, count(*) AS n, count(DISTINCT event_id % 50) AS sessions, max(ts) AS last_ts FROM events GROUP BY ALL",
    "vault_statistics": "SELECT 'type' AS dimension, p_type AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'category', p_brand, count(*) FROM part GROUP BY ALL",
    "source_query_history": f"WITH {_LOG} SELECT log_id, ts, query FROM log WHERE ts >= TIMESTAMP '1996-01-01' AND user = 'u3' AND query ILIKE '%left join%' ORDER BY ts DESC, log_id LIMIT 50",
}
