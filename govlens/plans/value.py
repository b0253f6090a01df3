"""Asset value and portfolio queries.

The query log is made of orders: each order is a query of one of five shapes; initiatives are parts, products are suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions.scratch import table
from govlens.operators import portfolio, usage
from govlens.operators.graph import ranked
from govlens.sources.tables import read

REFERENCE = "1998-08-02 00:00:00"
_T = "CASE WHEN {k} % 7 < 5 THEN 'sales.t' || ({k} % 11) ELSE 'Ref.\"T' || ({k} % 3) || '\"' END"
_LEFT, _RIGHT = _T.format(k="o_custkey"), _T.format(k="(o_orderkey + o_custkey)")
_QUERY = f"""CASE o_orderkey % 5
  WHEN 0 THEN 'SELECT * FROM ' || {_LEFT}
  WHEN 1 THEN 'SELECT a.x FROM ' || {_LEFT} || ' a LEFT JOIN ' || {_RIGHT} || ' b ON a.id = b.id'
  WHEN 2 THEN 'SELECT count(*) FROM ' || {_LEFT} || ' a JOIN ' || {_RIGHT} || ' b ON a.k = b.k GROUP BY 1'
  WHEN 3 THEN 'INSERT INTO ' || {_LEFT} || ' SELECT * FROM ' || {_RIGHT}
  ELSE 'UPDATE ' || {_LEFT} || ' SET x = 1' END"""
_LOG = f"log AS (SELECT o_orderkey AS log_id, {_QUERY} AS query, o_orderdate AS ts, 'u' || (o_custkey % 17) AS user, CASE WHEN o_orderkey % 4 <> 0 THEN 'p' || (o_orderkey % 6) END AS data_product FROM orders)"


def log(spark, d):
    o = read(spark, d, "orders")
    return o.selectExpr("o_orderkey AS log_id", f"{_QUERY} AS query", "o_orderdate AS ts", "'u' || (o_custkey % 17) AS user", "CASE WHEN o_orderkey % 4 <> 0 THEN 'p' || (o_orderkey % 6) END AS data_product")


_CLEAN = "lower(regexp_replace({c}, '[\"`\\[\\]]', '', 'g'))"
_NAME = '["`\\[]?[\\w.]+["`\\]]?'
_REFS = f"""{_LOG}, h AS (SELECT log_id, unnest(regexp_extract_all(query, '(?i)\\b(?:from|join|into|update)\\s+{_NAME}')) AS hit, generate_subscripts(regexp_extract_all(query, '(?i)\\b(?:from|join|into|update)\\s+{_NAME}'), 1) - 1 AS seq FROM log),
  refs AS (SELECT log_id, seq, lower(regexp_split_to_array(hit, '\\s+')[1]) AS keyword, {_CLEAN.format(c="regexp_split_to_array(hit, '\\s+')[2]")} AS asset FROM h),
  used AS (SELECT log_id, asset, CASE WHEN upper(query) LIKE 'INSERT%' THEN CASE WHEN keyword = 'into' THEN 'etl_target' ELSE 'etl_source' END WHEN upper(query) LIKE 'UPDATE%' OR upper(query) LIKE 'DELETE%' THEN 'etl_target'
    WHEN regexp_matches(upper(query), '\\bGROUP BY\\b|\\b(SUM|COUNT|AVG|MIN|MAX)\\s*\\(') THEN 'aggregation' WHEN seq = 0 THEN 'direct_query' ELSE 'join_source' END AS usage_type,
    substr(md5(query), 1, 12) AS query_hash, ts, user, data_product FROM log JOIN refs USING (log_id))"""
_PAIRS = f"""j AS (SELECT data_product, {_CLEAN.format(c=f"regexp_extract(query, '(?i)\\bfrom\\s+({_NAME})', 1)")} AS left_asset, unnest(regexp_extract_all(query, '(?i)(?:(?:left|right|full|inner|cross)\\s+(?:outer\\s+)?)?join\\s+{_NAME}')) AS j FROM log),
  pairs AS (SELECT left_asset, {_CLEAN.format(c=f"regexp_extract(j, '(?i)join\\s+({_NAME})', 1)")} AS right_asset, CASE WHEN regexp_matches(j, '(?i)^left') THEN 'LEFT' ELSE 'INNER' END AS join_type, count(*) AS frequency,
    coalesce(list_sort(list(DISTINCT data_product) FILTER (data_product IS NOT NULL)), []) AS data_products FROM j GROUP BY 1, 2, 3)"""
_USCORE = """us AS (SELECT asset, count(*) AS queries, count(DISTINCT user) AS users, count(DISTINCT data_product) AS products, count(DISTINCT usage_type) AS types FROM used WHERE ts >= TIMESTAMP '1998-08-02' - INTERVAL 365 DAY GROUP BY asset),
  uscore AS (SELECT *, least(100.0, least(100.0, queries / 1000 * 100) * (least(1.5, 1 + users / 10) * least(1.3, 1 + products / 5)) * (0.7 + 0.3 * types / 12)) AS usage_score FROM us)"""
_JSCORE = """ends AS (SELECT left_asset AS asset, right_asset AS other, frequency, data_products FROM pairs UNION ALL SELECT right_asset, left_asset, frequency, data_products FROM pairs WHERE left_asset <> right_asset),
  jn AS (SELECT asset, count(*) AS joins, sum(frequency)::BIGINT AS frequency, count(DISTINCT other) AS connected FROM ends GROUP BY asset),
  jp AS (SELECT asset, count(DISTINCT p) AS products FROM (SELECT asset, unnest(data_products) AS p FROM ends) GROUP BY asset),
  jscore AS (SELECT jn.*, coalesce(products, 0) AS products, least(100.0, least(100.0, frequency / 50 * 100) * least(1.5, 1 + connected / 20) * least(1.3, 1 + coalesce(products, 0) / 5)) AS join_score FROM jn LEFT JOIN jp USING (asset))"""


def references(spark, d):
    return usage.references(log(spark, d))


def usages(spark, d):
    return usage.usages(log(spark, d))


def join_pairs(spark, d):
    return usage.join_pairs(log(spark, d))


def join_columns(spark, d):
    return usage.join_columns(log(spark, d)).groupBy("left_column", "right_column").agg(F.count(F.lit(1)).alias("n"))


def usage_scores(spark, d):
    return usage.usage_scores(usages(spark, d), REFERENCE, days=365).withColumn("usage_score", F.round("usage_score", 6))


def join_scores(spark, d):
    return usage.join_scores(join_pairs(spark, d)).withColumn("join_score", F.round("join_score", 6))


def usage_trend(spark, d):
    return usage.trend(usages(spark, d), REFERENCE, days=365)


def _lineage(spark, d, used=None):
    e = (used if used is not None else usages(spark, d)).filter("usage_type like 'etl%'")
    moves = e.filter("usage_type = 'etl_source'").select("log_id", F.col("asset").alias("src")).join(e.filter("usage_type = 'etl_target'").select("log_id", F.col("asset").alias("dst")), "log_id").select("src", "dst").distinct()
    ends = moves.select(F.col("src").alias("asset"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(moves.select(F.col("dst").alias("asset"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("asset").agg(F.sum("o").alias("downstream"), F.sum("i").alias("upstream")).withColumn("critical", F.col("downstream") >= 3)


def lineage_scores(spark, d):
    return usage.lineage_scores(_lineage(spark, d)).withColumn("lineage_score", F.round("lineage_score", 6))


def _products(spark, d):
    s = read(spark, d, "nation")
    return s.selectExpr("'p' || n_nationkey AS product", "n_nationkey + 1 AS consumers", "CASE n_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS revenue_impact", "array('sales.t' || (n_nationkey % 11), 'ref.t' || (n_nationkey % 3)) AS assets", "array('ref.t' || (n_nationkey % 2)) AS critical_assets")


def product_impacts(spark, d):
    return usage.product_impacts(_products(spark, d), usages(spark, d))


def product_asset_scores(spark, d):
    return usage.product_scores(product_impacts(spark, d)).withColumn("product_score", F.round("product_score", 6))


def _value(spark, d):
    used = table(usages(spark, d), "usages")  # four scores read it
    parts = [usage.usage_scores(used, REFERENCE, days=365), usage.join_scores(usage.join_pairs(log(spark, d))), usage.lineage_scores(_lineage(spark, d, used)), usage.product_scores(usage.product_impacts(_products(spark, d), used))]
    meta = read(spark, d, "nation").selectExpr("'sales.t' || n_nationkey AS asset", "CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS criticality", "CASE n_nationkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS risk_level", "n_nationkey % 4 = 0 AS has_pii", "n_nationkey AS sla_count")
    return usage.asset_value(parts, meta)


def asset_value(spark, d):
    out = _value(spark, d)
    return out.select("asset", *[F.round(c, 6).alias(c) for c in ("usage_score", "join_score", "lineage_score", "product_score", "overall")], "category", F.round("business_impact", 6).alias("business_impact"))


def value_report(spark, d):
    out = usage.report(_value(spark, d), usage_trend(spark, d), usage.join_scores(join_pairs(spark, d)))
    return out.withColumn("mean_score", F.round("mean_score", 6))


_LSCORE = """mv AS (SELECT DISTINCT s.asset AS src, t.asset AS dst FROM used s JOIN used t USING (log_id) WHERE s.usage_type = 'etl_source' AND t.usage_type = 'etl_target'),
  le AS (SELECT src AS asset, 1 AS o, 0 AS i FROM mv UNION ALL SELECT dst, 0, 1 FROM mv), lc AS (SELECT asset, sum(o)::BIGINT AS downstream, sum(i)::BIGINT AS upstream, sum(o) >= 3 AS critical FROM le GROUP BY asset),
  lscore AS (SELECT *, least(100.0, least(100.0, downstream / 20 * 100) * CASE WHEN downstream > upstream THEN 1.5 ELSE 1.0 END * CASE WHEN critical THEN 1.5 ELSE 1.0 END) AS lineage_score FROM lc)"""
_IMPACTS = """pr AS (SELECT 'p' || n_nationkey AS product, n_nationkey + 1 AS consumers, CASE n_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS revenue_impact, unnest(['sales.t' || (n_nationkey % 11), 'ref.t' || (n_nationkey % 3)]) AS asset, 'ref.t' || (n_nationkey % 2) AS crit FROM nation),
  pk AS (SELECT asset, data_product AS product, list_sort(list(DISTINCT usage_type)) AS usage_types FROM used GROUP BY 1, 2),
  imp AS (SELECT product, asset, consumers, revenue_impact, asset = crit AS critical, coalesce(usage_types, ['unknown']) AS usage_types FROM pr LEFT JOIN pk USING (asset, product)),
  pa AS (SELECT asset, count(*) AS n_products, count(*) FILTER (critical) AS critical_paths, sum(consumers)::BIGINT AS consumers, sum(CASE revenue_impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)::BIGINT AS revenue FROM imp GROUP BY asset),
  pscore AS (SELECT *, least(100.0, least(100.0, n_products / 10 * 100) * (1 + 0.2 * critical_paths) * least(1.5, 1 + consumers / 50) * least(1.5, 1 + revenue / 10)) AS product_score FROM pa)"""
_VALUE = f"""WITH {_REFS}, {_PAIRS}, {_USCORE}, {_JSCORE}, {_LSCORE}, {_IMPACTS},
  al AS (SELECT asset FROM uscore UNION SELECT asset FROM jscore UNION SELECT asset FROM lscore UNION SELECT asset FROM pscore),
  sc AS (SELECT asset, coalesce(usage_score, 0) AS usage_score, coalesce(join_score, 0) AS join_score, coalesce(lineage_score, 0) AS lineage_score, coalesce(product_score, 0) AS product_score FROM al LEFT JOIN uscore USING (asset) LEFT JOIN jscore USING (asset) LEFT JOIN lscore USING (asset) LEFT JOIN pscore USING (asset)),
  md AS (SELECT 'sales.t' || n_nationkey AS asset, CASE n_nationkey % 3 WHEN 0 THEN 1.3 WHEN 1 THEN 0.7 ELSE 1.0 END AS cf, CASE n_nationkey % 2 WHEN 0 THEN 1.2 ELSE 0.9 END AS rf, CASE WHEN n_nationkey % 4 = 0 THEN 1.2 ELSE 1.0 END AS pf, least(1.3, 1 + 0.1 * n_nationkey) AS sf FROM nation),
  ov AS (SELECT *, usage_score * 0.3 + join_score * 0.25 + lineage_score * 0.25 + product_score * 0.2 AS overall FROM sc),
  val AS (SELECT ov.*, CASE WHEN overall >= 80 THEN 'critical' WHEN overall >= 60 THEN 'high' WHEN overall >= 40 THEN 'medium' WHEN overall >= 20 THEN 'low' ELSE 'unknown' END AS category, least(100.0, overall * coalesce(cf * rf * pf * sf, 1.0)) AS business_impact FROM ov LEFT JOIN md USING (asset))"""
_TREND = """tr AS (SELECT asset, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '1998-08-02' - INTERVAL 182 DAY) AS recent, count(*) FILTER (ts >= TIMESTAMP '1998-08-02' - INTERVAL 365 DAY AND ts < TIMESTAMP '1998-08-02' - INTERVAL 182 DAY) AS older FROM used GROUP BY asset),
  trend AS (SELECT asset, recent, older, CASE WHEN n < 2 THEN 'stable' WHEN older = 0 THEN CASE WHEN recent > 0 THEN 'increasing' ELSE 'stable' END WHEN recent / older > 1.2 THEN 'increasing' WHEN recent / older < 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM tr)"""

RISKS = {"technical": ["r1", "r2", "r3"], "organizational": ["r2", "r4"], "external": ["r3", "r5"], "ai_specific": ["r1", "r5"]}
_INI = """ini AS (SELECT p_partkey AS initiative, p_retailprice * 100 AS investment, p_retailprice * (30 + p_size) AS benefit, p_retailprice * 10 AS cost, (p_size * 2)::DOUBLE AS r1, ((p_partkey * 7) % 100)::DOUBLE AS r2, ((p_partkey * 13) % 100)::DOUBLE AS r3, ((p_partkey * 29) % 100)::DOUBLE AS r4, ((p_partkey * 31) % 100)::DOUBLE AS r5,
  ((p_partkey * 3) % 101)::DOUBLE AS strategic, ((p_partkey * 11) % 101)::DOUBLE AS operational FROM part)"""
_INI_COLS = ["p_partkey AS initiative", "p_retailprice * 100 AS investment", "p_retailprice * (30 + p_size) AS benefit", "p_retailprice * 10 AS cost", "double(p_size * 2) AS r1", "double((p_partkey * 7) % 100) AS r2", "double((p_partkey * 13) % 100) AS r3", "double((p_partkey * 29) % 100) AS r4", "double((p_partkey * 31) % 100) AS r5", "double((p_partkey * 3) % 101) AS strategic", "double((p_partkey * 11) % 101) AS operational"]


def _initiatives(spark, d):
    df = portfolio.risk_scores(read(spark, d, "part").selectExpr(*_INI_COLS), RISKS)
    df = df.withColumn("npv", portfolio.npv(F.col("investment"), F.col("benefit"), F.col("cost"))).withColumn("roi", portfolio.roi(F.col("investment"), F.col("benefit") * 3)).withColumn("payback", portfolio.payback_months(F.col("investment"), F.col("benefit"), F.col("cost")))
    df = df.withColumn("financial", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.col("roi") / 4))).withColumn("risk_adjusted", 100 - F.col("overall_risk"))
    return portfolio.initiative_scores(df)


def initiatives(spark, d):
    keep = ["initiative", *[F.round(c, 4).alias(c) for c in ("npv", "roi", "overall_risk", "overall")], "payback", "risk_level", "category", "recommendation"]
    return _initiatives(spark, d).select(*keep)


def initiative_rank(spark, d):
    df = _initiatives(spark, d).select("initiative", F.round("overall", 4).alias("overall"))
    return ranked(df, "overall", "initiative")


def initiative_irr(spark, d):
    return portfolio.irr_of(read(spark, d, "part").selectExpr(*_INI_COLS), "investment", "benefit", "cost").select("initiative", F.round("irr", 4).alias("irr"))


def portfolio_report(spark, d):
    out = portfolio.portfolio_report(_initiatives(spark, d))
    return out.select("initiatives", *[F.round(c, 2).alias(c) for c in ("investment", "benefit", "mean_score", "roi")], "quick_wins", "high_risk")


_INITIATIVES = f"""WITH {_INI}, a AS (SELECT *, (r1 + r2 + r3) / 3 * 0.30 + (r2 + r4) / 2 * 0.25 + (r3 + r5) / 2 * 0.20 + (r1 + r5) / 2 * 0.25 AS overall_risk,
    -investment + (benefit - cost) / 1.1 + (benefit * 1.05 - cost) / pow(1.1, 2) + (benefit * pow(1.05, 2) - cost) / pow(1.1, 3) AS npv, (benefit * 3 - investment) / investment * 100 AS roi,
    CASE WHEN benefit <= cost THEN 999 ELSE least(120, floor(investment / (benefit - cost) * 12)::INT) END AS payback FROM ini),
  b AS (SELECT *, CASE WHEN overall_risk >= 75 THEN 'critical' WHEN overall_risk >= 60 THEN 'high' WHEN overall_risk >= 40 THEN 'medium' WHEN overall_risk >= 20 THEN 'low' ELSE 'minimal' END AS risk_level,
    greatest(0.0, least(100.0, 50 + roi / 4)) * 0.35 + strategic * 0.25 + operational * 0.20 + (100 - overall_risk) * 0.20 AS overall FROM a),
  c AS (SELECT *, CASE WHEN overall >= 85 THEN 'transformational' WHEN overall >= 70 THEN 'high' WHEN overall >= 50 THEN 'medium' WHEN overall >= 30 THEN 'low' ELSE 'experimental' END AS category,
    CASE WHEN overall >= 85 AND roi > 100 AND risk_level IN ('low', 'minimal') THEN 'INVEST - High priority strategic initiative' WHEN overall >= 70 AND roi > 50 THEN 'INVEST - Strong business case' WHEN overall >= 50 AND roi > 0 THEN 'CONSIDER - Moderate value, review priorities'
      WHEN overall >= 30 THEN 'DEFER - Limited value, consider alternatives' ELSE 'DECLINE - Insufficient business case' END AS recommendation FROM b)"""

_PROD = ["s_suppkey AS product", "CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS purpose", "CASE WHEN s_suppkey % 4 <> 0 THEN 'x' ELSE '' END AS outcomes", "s_suppkey % 6 AS n_consumers"] + [f"CASE WHEN s_suppkey % {m} <> 0 THEN 'x' END AS {c}" for m, c in ((2, "schema_text"), (3, "granularity"), (5, "sla_hours"), (7, "freshness_hours"), (4, "semantics"), (6, "rules"), (8, "version"), (2, "owner"), (3, "steward"), (5, "classification"), (7, "lineage"), (4, "access"), (6, "pii"), (9, "retention"), (2, "format"), (3, "channel"))] + ["CAST((s_suppkey % 10) AS DOUBLE) / 10 AS quality", "CAST((s_suppkey * 7) % 100 AS DOUBLE) AS value"]


def product_scores(spark, d):
    out = portfolio.data_product_scores(read(spark, d, "supplier").selectExpr(*_PROD))
    return out.select("product", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("_score") or c == "overall"], "status")


def product_summary(spark, d):
    return product_scores(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("products"), F.round(F.avg("overall"), 4).alias("mean_score"))


def _share(*names: str) -> str:
    return "(" + " + ".join(f"coalesce({n} <> '', false)::INT" for n in names) + f") / {len(names)} * 100"


_PSQL = f"""WITH p AS (SELECT {', '.join(_PROD)} FROM supplier), s AS (SELECT product, {_share('purpose', 'outcomes')} AS purpose_score, CASE WHEN n_consumers = 0 THEN 0 WHEN n_consumers = 1 THEN 60 WHEN n_consumers <= 3 THEN 80 ELSE 100 END::DOUBLE AS consumers_score,
    {_share('schema_text', 'granularity', 'sla_hours', 'freshness_hours', 'semantics', 'rules', 'version')} AS contract_score, greatest(0.0, least(100.0, quality * 100)) AS quality_score,
    {_share('owner', 'steward', 'classification', 'lineage', 'access', 'pii', 'retention')} AS governance_score, {_share('format', 'channel')} AS delivery_score, value AS value_score FROM p),
  o AS (SELECT *, purpose_score * 0.15 + consumers_score * 0.1 + contract_score * 0.2 + quality_score * 0.2 + governance_score * 0.15 + delivery_score * 0.1 + value_score * 0.1 AS overall FROM s),
  q AS (SELECT product, {', '.join(f'round({c}, 6) AS {c}' for c in [k + '_score' for k in portfolio.PRODUCT_WEIGHTS] + ['overall'])}, CASE WHEN overall >= 80 THEN 'excellent' WHEN overall >= 60 THEN 'good' WHEN overall >= 40 THEN 'fair' ELSE 'poor' END AS status FROM o)"""

_META = ["p_name AS name", "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN 'short' ELSE 'A long description of ' || p_brand END AS description", "CASE WHEN p_partkey % 3 = 0 THEN 'o' ELSE '' END AS owner", "p_partkey % 2 AS tags", "CASE WHEN p_partkey % 5 = 0 THEN 'internal' END AS classification", "p_size % 7 AS documented", "7 AS columns", "p_partkey AS k"]


def metadata_scores(spark, d):
    df = read(spark, d, "part").selectExpr(*_META).withColumn("name", F.concat_ws("#", "name", F.col("k").cast("string")))
    df = df.withColumn("description", F.when(F.col("k") % 4 == 1, F.col("name")).otherwise(F.col("description")))
    return portfolio.metadata_scores(df).withColumn("score", F.round("score", 6))


QUERIES = {
    "usage_references": references, "usage_usages": usages, "usage_join_pairs": join_pairs, "usage_join_columns": join_columns, "usage_scores": usage_scores, "usage_join_scores": join_scores,
    "usage_trend": usage_trend, "usage_lineage_scores": lineage_scores, "usage_product_impacts": product_impacts, "usage_product_asset_scores": product_asset_scores, "asset_value": asset_value,
    "asset_value_report": value_report, "portfolio_initiatives": initiatives, "portfolio_rank": initiative_rank, "portfolio_irr": initiative_irr, "portfolio_report": portfolio_report,
    "product_scores": product_scores, "product_summary": product_summary, "metadata_scores": metadata_scores,
}

ORACLE = {
    "usage_references": f"WITH {_REFS} SELECT * FROM refs",
    "usage_usages": f"WITH {_REFS} SELECT * FROM used",
    "usage_join_pairs": f"WITH {_LOG}, {_PAIRS} SELECT * FROM pairs",
    "usage_join_columns": f"WITH {_LOG}, e AS (SELECT unnest(regexp_extract_all(query, '\\w+\\.\\w+\\s*=\\s*\\w+\\.\\w+')) AS eq FROM log) SELECT lower(trim(split_part(eq, '=', 1))) AS left_column, lower(trim(split_part(eq, '=', 2))) AS right_column, count(*) AS n FROM e GROUP BY ALL",
    "usage_scores": f"WITH {_REFS}, {_USCORE} SELECT asset, queries, users, products, types, round(usage_score, 6) AS usage_score FROM uscore",
    "usage_join_scores": f"WITH {_LOG}, {_PAIRS}, {_JSCORE} SELECT asset, joins, frequency, connected, products, round(join_score, 6) AS join_score FROM jscore",
    "usage_trend": f"WITH {_REFS}, {_TREND} SELECT * FROM trend",
    "usage_lineage_scores": f"WITH {_REFS}, {_LSCORE} SELECT asset, downstream, upstream, critical, round(lineage_score, 6) AS lineage_score FROM lscore",
    "usage_product_impacts": f"WITH {_REFS}, {_IMPACTS} SELECT * FROM imp",
    "usage_product_asset_scores": f"WITH {_REFS}, {_IMPACTS} SELECT asset, n_products, critical_paths, consumers, revenue, round(product_score, 6) AS product_score FROM pscore",
    "asset_value": f"{_VALUE} SELECT asset, {', '.join(f'round({c}, 6) AS {c}' for c in ('usage_score', 'join_score', 'lineage_score', 'product_score', 'overall', 'business_impact'))}, category FROM val",
    "asset_value_report": f"""{_VALUE}, {_TREND} SELECT count(*) AS assets, round(avg(overall), 6) AS mean_score, count(*) FILTER (category = 'critical') AS critical, count(*) FILTER (category = 'unknown') AS orphan, count(*) FILTER (trend = 'decreasing') AS declining, count(*) FILTER (joins >= 5) AS hubs,
      (SELECT coalesce(string_agg(asset, ',' ORDER BY overall DESC, asset), '') FROM (SELECT asset, overall FROM val WHERE overall >= 50 ORDER BY overall DESC, asset LIMIT 10)) AS top FROM val LEFT JOIN trend USING (asset) LEFT JOIN jscore USING (asset)""",
    "portfolio_initiatives": f"{_INITIATIVES} SELECT initiative, round(npv, 4) AS npv, round(roi, 4) AS roi, round(overall_risk, 4) AS overall_risk, round(overall, 4) AS overall, payback, risk_level, category, recommendation FROM c",
    "portfolio_rank": f"{_INITIATIVES}, r AS (SELECT initiative, round(overall, 4) AS overall FROM c) SELECT *, row_number() OVER (ORDER BY overall DESC, initiative) AS rank FROM r",
    "portfolio_report": f"{_INITIATIVES} SELECT count(*) AS initiatives, round(sum(investment), 2) AS investment, round(sum(benefit), 2) AS benefit, round(avg(overall), 2) AS mean_score, round((sum(benefit) - sum(investment)) / sum(investment) * 100, 2) AS roi, count(*) FILTER (overall >= 60 AND investment < (SELECT avg(investment) FROM c) AND payback <= 18) AS quick_wins, count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk FROM c",
    "product_scores": f"{_PSQL} SELECT * FROM q",
    "product_summary": f"{_PSQL} SELECT status, count(*) AS products, round(avg(overall), 4) AS mean_score FROM q GROUP BY status",
    "metadata_scores": f"""WITH m AS (SELECT {', '.join(_META)} FROM part), s AS (SELECT name || '#' || k AS name, 0.30 * CASE WHEN k % 4 = 3 THEN 0.3 ELSE 0 END + 0.1 * (owner <> '')::INT + 0.1 * (tags > 0)::INT + 0.1 * (classification IS NOT NULL)::INT + 0.4 * (documented / columns) AS score FROM m)
      SELECT name, round(score, 6) AS score, CASE WHEN score < 0.3 THEN 'poor' WHEN score < 0.7 THEN 'partial' ELSE 'good' END AS status FROM s""",
}
