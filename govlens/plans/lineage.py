"""Lineage queries on graphs derived from the driver's tables.

``dag``: part to supplier (lineitem), supplier to nation, customer to nation, nation to region. ``cyclic``: event types that follow one another for a user.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.functions.scratch import table
from govlens.operators import graph, workflow
from govlens.sources.tables import read


def _id(kind: str, c: str):
    return F.concat(F.lit(kind + ":"), F.col(c).cast("string"))


def dag(spark, d):
    t = lambda n: read(spark, d, n)
    e = t("lineitem").select("l_partkey", "l_suppkey").distinct().select(_id("part", "l_partkey").alias("src"), _id("supp", "l_suppkey").alias("dst"))
    return (
        e.unionByName(t("supplier").select(_id("supp", "s_suppkey").alias("src"), _id("nation", "s_nationkey").alias("dst")))
        .unionByName(t("customer").select(_id("cust", "c_custkey").alias("src"), _id("nation", "c_nationkey").alias("dst")))
        .unionByName(t("nation").select(_id("nation", "n_nationkey").alias("src"), _id("region", "n_regionkey").alias("dst")))
    )


def cyclic(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return e.filter("dst is not null").select("src", "dst").distinct()


def both(spark, d):
    """The edges of both graphs, written once, as nodes and several steps read them."""
    return table(dag(spark, d).unionByName(cyclic(spark, d)), "lineage-edges")


def _nodes(e):
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


_DAG = """dag AS (SELECT DISTINCT 'part:' || l_partkey AS src, 'supp:' || l_suppkey AS dst FROM lineitem
  UNION ALL SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'cust:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
  dn AS (SELECT src AS id FROM dag UNION SELECT dst FROM dag),
  dg AS (SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree FROM dn
    LEFT JOIN (SELECT dst AS id, count(*) AS i FROM dag GROUP BY dst) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM dag GROUP BY src) USING (id))"""
_CYC = """cyc AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
  cn AS (SELECT src AS id FROM cyc UNION SELECT dst FROM cyc)"""

START = ("part:1", "part:7", "cust:3")


def reach_down(spark, d):
    return graph.reach(dag(spark, d), _ids(spark, *START))


def reach_up(spark, d):
    return graph.reach(dag(spark, d), _ids(spark, "nation:3"), reverse=True)


def reach_cyclic(spark, d):
    e = cyclic(spark, d)
    return graph.reach(e, e.agg(F.min("src").alias("id"))).select("id")


def impact(spark, d):
    return graph.impact(dag(spark, d), _ids(spark, *START))


def two_hops(spark, d):
    return graph.blast_radius(dag(spark, d), _ids(spark, "part:1"))


def subgraph(spark, d):
    e = dag(spark, d)
    return graph.subgraph(e, _nodes(e).filter("id like 'nation:%' or id like 'region:%'"))


def degrees(spark, d):
    e = dag(spark, d)
    return graph.degrees(_nodes(e), e)


def roles(spark, d):
    e = dag(spark, d)
    return graph.roles(_nodes(e), e)


def metrics(spark, d):
    e = dag(spark, d)
    return graph.metrics(_nodes(e), e).withColumn("density", F.round("density", 12)).withColumn("mean_degree", F.round("mean_degree", 9))


def components(spark, d):
    e = both(spark, d)
    return graph.weak_components(_nodes(e), e)


def component_sizes(spark, d):
    e = both(spark, d)
    return graph.component_sizes(_nodes(e), e)


def levels(spark, d):
    e = dag(spark, d)
    return graph.peel(_nodes(e), e)[0]


def cycle_dag(spark, d):
    e = dag(spark, d)
    return graph.cycle_summary(_nodes(e), e)


def cycle_cyclic(spark, d):
    e = cyclic(spark, d)
    return graph.cycle_summary(_nodes(e), e)


def strong(spark, d):
    e = cyclic(spark, d)
    return graph.strong_components(e, _nodes(e))


def simple_cycles(spark, d):
    return graph.cycles(cyclic(spark, d)).select(F.array_join("path", ">").alias("path"), "length")


def clustering(spark, d):
    e = both(spark, d)
    return graph.clustering(e).withColumn("coefficient", F.round("coefficient", 9))


def distances(spark, d):
    e = dag(spark, d)
    return graph.distances(e, _nodes(e), _ids(spark, "nation:1"))


def versions(spark, d):
    e = dag(spark, d)
    old = e.filter("src not like 'cust:%'").unionByName(e.filter("src like 'nation:%'").select(F.col("src"), F.lit("region:old").alias("dst")))
    return graph.compare(old, e)


def version_risk(spark, d):
    return graph.change_risk(versions(spark, d))


def top_nodes(spark, d):
    e = dag(spark, d)
    return graph.top_nodes(_nodes(e), e)


def layers(spark, d):
    e = dag(spark, d)
    return graph.layer_edges(e, _nodes(e).withColumn("layer", F.substring_index("id", ":", 1)))


def run_events(spark, d):
    """Run events made of orders: a job per priority reads the customer's market segment and writes the order's status."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    kind = F.element_at(F.array(F.lit("COMPLETE"), F.lit("START"), F.lit("RUNNING")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    ev = o.join(c, o.o_custkey == c.c_custkey).select(kind.alias("event_type"), F.concat(F.lit("job/"), F.substring("o_orderpriority", 1, 1)).alias("job"), F.array("c_mktsegment").alias("inputs"), F.array("o_orderstatus").alias("outputs"))
    return graph.event_edges(ev)


def downstream_sizes(spark, d):
    """How many nodes every node leads to."""
    return graph.downstream_sizes(dag(spark, d))


def failure_risk(spark, d):
    """Of each kind of node: points of failure, the most that hangs on one, bottlenecks, whether the graph has a cycle, and the risk of all that."""
    e = table(dag(spark, d), "lineage-edges")
    kind = F.substring_index("id", ":", 1)
    points = graph.failure_points(e).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("points"), F.max("downstream").alias("most_downstream"))
    flags = graph.roles(_nodes(e), e).groupBy(kind.alias("kind")).agg(F.count_if("bottleneck").alias("bottlenecks"))
    cyclic_ = graph.cycle_summary(_nodes(e), e).select("has_cycle")
    out = flags.join(points, "kind", "left").select("kind", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("most_downstream", F.lit(0)).alias("most_downstream"), "bottlenecks")
    return out.join(F.broadcast(cyclic_)).withColumn("risk", workflow.graph_risk(F.col("points"), F.col("has_cycle"), F.col("bottlenecks")))


def articulation(spark, d):
    return graph.articulation_points(dag(spark, d))


def betweenness(spark, d):
    return graph.betweenness(dag(spark, d)).withColumn("score", F.round("score", 6))


def communities(spark, d):
    return graph.label_groups(dag(spark, d))


def independent_paths(spark, d):
    return graph.independent_paths(dag(spark, d)).withColumn("path", F.array_join("path", ">"))


QUERIES = {
    "lineage_reach_down": reach_down, "lineage_reach_up": reach_up, "lineage_reach_cyclic": reach_cyclic, "lineage_impact": impact, "lineage_two_hops": two_hops,
    "lineage_subgraph": subgraph, "lineage_degrees": degrees, "lineage_roles": roles, "lineage_metrics": metrics, "lineage_components": components,
    "lineage_component_sizes": component_sizes, "lineage_levels": levels, "lineage_cycle_dag": cycle_dag, "lineage_cycle_cyclic": cycle_cyclic,
    "lineage_strong_components": strong, "lineage_simple_cycles": simple_cycles, "lineage_clustering": clustering, "lineage_distances": distances,
    "lineage_version_diff": versions, "lineage_version_risk": version_risk, "lineage_top_nodes": top_nodes, "lineage_layers": layers, "lineage_run_events": run_events,
    "lineage_articulation_points": articulation, "lineage_betweenness": betweenness, "lineage_communities": communities,
    "lineage_downstream_sizes": downstream_sizes, "lineage_failure_risk": failure_risk,
    "lineage_independent_paths": independent_paths,
}

_START = ", ".join(f"('{s}')" for s in START)
_DOWN = f"WITH RECURSIVE {_DAG}, r(id, hops) AS (SELECT DISTINCT dst, 1 FROM dag WHERE src IN (VALUES {_START}) UNION SELECT dag.dst, hops + 1 FROM r JOIN dag ON dag.src = r.id)"
_UP = f"WITH RECURSIVE {_DAG}, r(id, hops) AS (SELECT DISTINCT src, 1 FROM dag WHERE dst = 'nation:3' UNION SELECT dag.src, hops + 1 FROM r JOIN dag ON dag.dst = r.id)"
_COMPARE = f"""WITH {_DAG}, old AS (SELECT * FROM dag WHERE src NOT LIKE 'cust:%' UNION ALL SELECT src, 'region:old' FROM dag WHERE src LIKE 'nation:%'),
  oi AS (SELECT src AS id FROM old UNION SELECT dst FROM old),
  v AS (SELECT 'edge' AS kind, 'added' AS change, src, dst FROM (SELECT src, dst FROM dag EXCEPT SELECT src, dst FROM old)
    UNION ALL SELECT 'edge', 'removed', src, dst FROM (SELECT src, dst FROM old EXCEPT SELECT src, dst FROM dag)
    UNION ALL SELECT 'asset', 'added', id, NULL FROM (SELECT id FROM dn EXCEPT SELECT id FROM oi) UNION ALL SELECT 'asset', 'removed', id, NULL FROM (SELECT id FROM oi EXCEPT SELECT id FROM dn))"""

#: Both graphs, and the least label that reaches a node in so many rounds, which are more than any of their ways is long.
_BOTH = f"""{_DAG}, {_CYC}, al AS (SELECT * FROM dag UNION SELECT * FROM cyc), an AS (SELECT src AS id FROM al UNION SELECT dst FROM al), nb AS (SELECT src AS id, dst AS o FROM al UNION SELECT dst, src FROM al UNION SELECT id, id FROM an),
  lb(id, lab, k) AS (SELECT id, id, 0 FROM an UNION ALL SELECT nb.id, min(lb.lab), max(lb.k) + 1 FROM lb JOIN nb ON nb.o = lb.id WHERE lb.k < 12 GROUP BY nb.id), wc AS (SELECT id, lab AS component FROM lb WHERE k = 12),
  ad AS (SELECT id, (SELECT count(*) FROM al WHERE dst = an.id) AS i, (SELECT count(*) FROM al WHERE src = an.id) AS o FROM an),
  cs AS (SELECT component, count(*) AS size, count(*) FILTER (i = 0) AS sources, count(*) FILTER (o = 0) AS sinks FROM wc JOIN ad USING (id) GROUP BY component)"""
_VOTES = f"""{_DAG}, nb AS (SELECT src AS id, dst AS o FROM dag UNION SELECT dst, src FROM dag),
  lb(id, lab, k) AS (SELECT DISTINCT id, id, 0 FROM nb UNION ALL SELECT id, min(struct_pack(n := -c, l := lab)).l, max(k) FROM (SELECT nb.id, lb.lab, count(*) AS c, max(lb.k) + 1 AS k FROM lb JOIN nb ON nb.o = lb.id WHERE lb.k < 5 GROUP BY nb.id, lb.lab) GROUP BY id)"""

ORACLE = {
    "lineage_reach_down": f"{_DOWN} SELECT id, min(hops) AS hops FROM r GROUP BY id",
    "lineage_reach_up": f"{_UP} SELECT id, min(hops) AS hops FROM r GROUP BY id",
    "lineage_reach_cyclic": f"WITH RECURSIVE {_CYC}, r(id) AS (SELECT dst FROM cyc WHERE src = (SELECT min(src) FROM cyc) UNION SELECT cyc.dst FROM r JOIN cyc ON cyc.src = r.id) SELECT id FROM r",
    "lineage_impact": f"""WITH RECURSIVE {_DAG}, r(id) AS (SELECT dst FROM dag WHERE src IN (VALUES {_START}) UNION SELECT dag.dst FROM r JOIN dag ON dag.src = r.id),
      u(id) AS (SELECT src FROM dag WHERE dst IN (VALUES {_START}) UNION SELECT dag.src FROM u JOIN dag ON dag.dst = u.id), x AS (
      SELECT (SELECT count(*) FROM r) AS downstream, (SELECT count(*) FROM u) AS upstream, (SELECT count(*) FROM r JOIN dg USING (id) WHERE out_degree > 3) AS hot_nodes)
      SELECT *, CASE WHEN downstream > 10 THEN 'HIGH' WHEN downstream > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x""",
    "lineage_two_hops": f"WITH {_DAG}, a AS (SELECT dst AS id, 1 AS level FROM dag WHERE src = 'part:1'), b AS (SELECT DISTINCT dag.dst AS id, 2 AS level FROM a JOIN dag ON dag.src = a.id) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)",
    "lineage_subgraph": f"WITH {_DAG} SELECT src, dst FROM dag WHERE (src LIKE 'nation:%' OR src LIKE 'region:%') AND (dst LIKE 'nation:%' OR dst LIKE 'region:%')",
    "lineage_degrees": f"WITH {_DAG} SELECT * FROM dg",
    "lineage_roles": f"""WITH {_DAG}, m AS (SELECT avg(out_degree) AS mo, avg(in_degree) AS mi, avg(degree) AS md FROM dg)
      SELECT id, in_degree, out_degree, degree, in_degree = 0 AND out_degree > 0 AS source, out_degree = 0 AND in_degree > 0 AS sink, degree = 0 AS isolated, out_degree > 2 * mo AS hub,
        in_degree > 2 * mi AS frequent, out_degree >= 3 AS fan_out, in_degree >= 2 AND out_degree >= 2 AS bottleneck, degree > 3 * md AS heavy, in_degree > 5 OR out_degree > 5 AS busy FROM dg, m""",
    "lineage_metrics": f"WITH {_DAG} SELECT count(*) AS nodes, sum(out_degree)::BIGINT AS edges, round(avg(degree), 9) AS mean_degree, max(in_degree) AS max_in, max(out_degree) AS max_out, round(sum(out_degree) / (count(*) * (count(*) - 1)), 12) AS density FROM dg",
    "lineage_components": f"WITH RECURSIVE {_BOTH} SELECT * FROM wc",
    "lineage_component_sizes": f"""WITH RECURSIVE {_BOTH} SELECT component, size, sources, sinks, CASE WHEN sources = 1 AND sinks = 1 THEN 'linear' WHEN sources > 1 AND sinks = 1 THEN 'convergent' WHEN sources = 1 AND sinks > 1 THEN 'divergent' WHEN sources > 1 AND sinks > 1 THEN 'mesh' ELSE 'complex' END AS pattern,
      size > 1 AND component <> (SELECT component FROM cs ORDER BY size DESC, component DESC LIMIT 1) AS silo FROM cs""",
    "lineage_downstream_sizes": f"WITH RECURSIVE {_DAG}, r AS (SELECT src AS id, dst AS x FROM dag UNION SELECT r.id, dag.dst FROM r JOIN dag ON dag.src = r.x) SELECT dn.id, count(DISTINCT r.x) AS downstream FROM dn LEFT JOIN r ON r.id = dn.id AND r.x <> r.id GROUP BY dn.id",
    "lineage_communities": f"WITH RECURSIVE {_VOTES} SELECT id, lab AS community FROM lb WHERE k = 5",
    "lineage_cycle_cyclic": f"""WITH RECURSIVE {_CYC}, r(a, b) AS (SELECT src, dst FROM cyc UNION SELECT r.a, cyc.dst FROM r JOIN cyc ON cyc.src = r.b), lo AS (SELECT a AS id FROM r WHERE a = b), lf AS (SELECT id FROM lo UNION SELECT b FROM r JOIN lo ON a = id)
      SELECT count(*) > 0 AS has_cycle, count(*) AS nodes_left, CASE WHEN count(*) = 0 THEN 0 END AS longest_path FROM lf""",
    "lineage_distances": f"""WITH RECURSIVE {_DAG}, nb AS (SELECT src AS id, dst AS o FROM dag UNION SELECT dst, src FROM dag), r(id, h) AS (SELECT 'nation:1', 0 UNION SELECT id, min(h) + 1 FROM (SELECT nb.id, r.h FROM r JOIN nb ON nb.o = r.id WHERE r.h < 14) GROUP BY id)
      SELECT id, min(h) AS distance FROM dn LEFT JOIN r USING (id) GROUP BY id""",
    "lineage_betweenness": f"""WITH RECURSIVE {_DAG}, p(s, v, w, d) AS (SELECT DISTINCT src, src, 1::DOUBLE, 0 FROM dag UNION ALL SELECT p.s, dag.dst, sum(p.w), max(p.d) + 1 FROM p JOIN dag ON dag.src = p.v GROUP BY p.s, dag.dst)
      SELECT m.v AS id, round(sum(m.w * x.w / t.w), 6) AS score FROM p m JOIN p x ON x.s = m.v AND x.d > 0 JOIN p t ON t.s = m.s AND t.v = x.v WHERE m.d > 0 GROUP BY m.v""",
    "lineage_independent_paths": f"""WITH RECURSIVE {_DAG}, p(s, v, path) AS (SELECT id, id, [id] FROM dg WHERE in_degree = 0 UNION ALL SELECT p.s, dag.dst, min(list_append(p.path, dag.dst)) FROM p JOIN dag ON dag.src = p.v GROUP BY p.s, dag.dst),
      w AS (SELECT s, v, path FROM p JOIN dg ON dg.id = p.v WHERE out_degree = 0 AND len(path) > 2),
      g(used, best) AS (SELECT ['']::VARCHAR[], NULL::STRUCT(s VARCHAR, v VARCHAR, path VARCHAR[])
        UNION ALL SELECT list_concat(used, b.path), b FROM (SELECT used, min(struct_pack(s := w.s, v := w.v, path := w.path)) AS b FROM g JOIN w ON NOT list_has_any(w.path, g.used) GROUP BY used))
      SELECT best.s AS source, best.v AS sink, array_to_string(best.path, '>') AS path FROM g WHERE best IS NOT NULL ORDER BY 1, 2 LIMIT 10""",
    "lineage_levels": f"WITH RECURSIVE {_DAG}, r(id, level) AS (SELECT id, 0 FROM dn WHERE id NOT IN (SELECT dst FROM dag) UNION SELECT dag.dst, level + 1 FROM r JOIN dag ON dag.src = r.id) SELECT id, max(level) AS level FROM r GROUP BY id",
    "lineage_cycle_dag": f"WITH RECURSIVE {_DAG}, r(id, level) AS (SELECT id, 1 FROM dn WHERE id NOT IN (SELECT dst FROM dag) UNION SELECT dag.dst, level + 1 FROM r JOIN dag ON dag.src = r.id) SELECT false AS has_cycle, 0 AS nodes_left, max(level) AS longest_path FROM r",
    "lineage_strong_components": f"""WITH RECURSIVE {_CYC}, r(a, b) AS (SELECT src, dst FROM cyc UNION SELECT r.a, cyc.dst FROM r JOIN cyc ON cyc.src = r.b)
      SELECT id, coalesce(greatest(id, (SELECT max(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = id)), id) AS component FROM cn""",
    "lineage_simple_cycles": f"""WITH RECURSIVE {_CYC}, p(path, tip, len) AS (SELECT [src], dst, 1 FROM cyc UNION ALL SELECT list_append(path, tip), cyc.dst, len + 1 FROM p JOIN cyc ON cyc.src = tip WHERE tip > path[1] AND NOT list_contains(path, tip) AND len < 5)
      SELECT array_to_string(path, '>') AS path, len AS length FROM p WHERE tip = path[1]""",
    "lineage_clustering": f"""WITH {_DAG}, {_CYC}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM (SELECT * FROM dag UNION ALL SELECT * FROM cyc) WHERE src <> dst),
      n AS (SELECT a AS id, b AS o FROM e UNION ALL SELECT b, a FROM e), deg AS (SELECT id, count(*) AS degree FROM n GROUP BY id),
      t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), k AS (SELECT id, count(*) AS triangles FROM (SELECT unnest([p, q, r]) AS id FROM t) GROUP BY id)
      SELECT id, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 9) AS coefficient FROM deg LEFT JOIN k USING (id)""",
    "lineage_version_diff": f"{_COMPARE} SELECT * FROM v",
    "lineage_version_risk": f"{_COMPARE}, x AS (SELECT count(*) FILTER (kind = 'asset') AS assets, count(*) FILTER (kind = 'asset' AND change = 'removed') AS removed FROM v) SELECT *, CASE WHEN assets > 10 OR removed > 5 THEN 'HIGH' WHEN assets > 5 OR removed > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x",
    "lineage_top_nodes": f"WITH {_DAG} SELECT * FROM dg WHERE degree > 2 ORDER BY degree DESC, id LIMIT 10",
    "lineage_layers": f"WITH {_DAG} SELECT split_part(src, ':', 1) AS from_layer, split_part(dst, ':', 1) AS to_layer, count(*) AS edges FROM dag GROUP BY ALL",
    "lineage_run_events": """WITH e AS (SELECT 'job/' || left(o_orderpriority, 1) AS job, c_mktsegment AS i, o_orderstatus AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 1)
      SELECT DISTINCT i AS src, job AS dst, 'READ' AS operation FROM e UNION SELECT job, o, 'WRITE' FROM e""",
}
