"""Lineage graph analytics over tables of nodes (id, type) and edges (src, dst, ...), as joins and loops of joins.

Loops keep their state in tables of the shared folder, so that a plan is never longer than one round; the only thing a round brings to the
driver is a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.functions.scratch import gone, table, together


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def reach(edges: DataFrame, start: DataFrame, reverse: bool = False, levels: int | None = None) -> DataFrame:
    """(id, hops) of what is downstream (or upstream) of the start ids, up to ``levels`` steps.

    A start node is part of the result only if it lies on a cycle or behind another start.
    """
    e = distinct_edges(edges).select(*(["dst", "src"] if reverse else ["src", "dst"])).toDF("a", "b")
    e = table(e, "reach-edges")
    frontier = start.select(F.col(start.columns[0]).alias("id")).distinct()
    fronts: list[DataFrame] = []
    while levels is None or len(fronts) < levels:
        found = frontier.join(e, frontier["id"] == e["a"]).select(F.col("b").alias("id")).distinct()
        if fronts:
            # what was found before is read as it lies, not written anew
            found = found.join(together(*fronts), "id", "left_anti")
        found = table(found.withColumn("hops", F.lit(len(fronts) + 1)), "reach-front")
        if found.isEmpty():
            break
        fronts.append(found)
        frontier = found.select("id")
    out = table(together(*fronts) if fronts else found, "reach")
    gone(e, *fronts, *([] if fronts and found is fronts[-1] else [found]))
    return out


def distances(edges: DataFrame, nodes: DataFrame, center: DataFrame) -> DataFrame:
    """(id, distance) from the centre over edges in either direction; null where there is no way."""
    e = distinct_edges(edges)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = reach(both, center).join(center.select(F.col(center.columns[0]).alias("id")), "id", "left_anti")
    zero = center.select(F.col(center.columns[0]).alias("id"), F.lit(0).alias("hops"))
    return nodes.select("id").join(ways.unionByName(zero), "id", "left").withColumnRenamed("hops", "distance")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree of every node."""
    e = distinct_edges(edges)
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    per = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    out = nodes.select("id").distinct().join(per, "id", "left")
    return out.select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"), (F.coalesce("i", F.lit(0)) + F.coalesce("o", F.lit(0))).alias("degree"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density, mean and greatest degrees."""
    d = degrees(nodes, edges)
    one = d.agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"), F.avg("degree").alias("mean_degree"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"))
    n = F.col("nodes")
    return one.withColumn("density", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(F.lit(0.0)))


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees with flags: source, sink, isolated, hub (out over twice the mean), frequent (in over twice the mean), fan_out (3 and more),
    bottleneck (in and out 2 and more), heavy (three times the mean degree), busy (over 5 in or out)."""
    d = degrees(nodes, edges)
    mean = d.agg(F.avg("out_degree").alias("mo"), F.avg("in_degree").alias("mi"), F.avg("degree").alias("md"))
    i, o = F.col("in_degree"), F.col("out_degree")
    flags = {
        "source": (i == 0) & (o > 0), "sink": (o == 0) & (i > 0), "isolated": (i + o) == 0, "hub": o > 2 * F.col("mo"), "frequent": i > 2 * F.col("mi"),
        "fan_out": o >= 3, "bottleneck": (i >= 2) & (o >= 2), "heavy": (i + o) > 3 * F.col("md"), "busy": (i > 5) | (o > 5),
    }
    return d.join(F.broadcast(mean)).select("id", "in_degree", "out_degree", "degree", *[c.alias(k) for k, c in flags.items()])


def _numbered(raw: DataFrame, a: str, b: str) -> tuple[DataFrame, int]:
    """(id, n) table of the ends of edges with different 64-bit numbers, and the number of the hash that gave them: if two ends share one, the next hash is taken."""
    ends = raw.select(F.col(a).alias("id")).unionByName(raw.select(F.col(b).alias("id"))).distinct()
    k = 0
    while True:
        names = table(ends.withColumn("n", F.xxhash64("id", F.lit(k))), "cc-names")
        if names.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
            return names, k
        gone(names)
        k += 1


def _ordered(names: DataFrame) -> DataFrame:
    """Adds place to a table of names (id, n): numbers in the order of the ids, the same for no two, with gaps; ranges of the order are sorted apart."""
    return table(names.repartitionByRange("id").sortWithinPartitions("id").withColumn("place", F.monotonically_increasing_id()), "ordered-names")


def _placed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, place) of the nodes, and the distinct edges (a, b) between different nodes by place, both as tables."""
    raw = table(edges.select("src", "dst").filter("src <> dst"), "placed-raw")
    names, k = _numbered(raw, "src", "dst")
    order = _ordered(names)
    e = raw.select(F.xxhash64("src", F.lit(k)).alias("u"), F.xxhash64("dst", F.lit(k)).alias("v")).distinct()
    e = e.join(order.select(F.col("n").alias("u"), F.col("place").alias("a")), "u").join(order.select(F.col("n").alias("v"), F.col("place").alias("b")), "v")
    e = table(e.select("a", "b"), "placed-edges")
    gone(raw, names)
    return order.select("id", "place"), e


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, component) of every node of an edge; component is its component's least id.

    By contraction: each round gives all numbers new ones by a hash that maps no two 64-bit numbers onto one, each node becomes the least number of itself and its
    neighbours (in every other round, one with a single neighbour becomes that one), and edges go on between what nodes became. So about half of the nodes go in
    a round whatever the graph, all leaves of a hub at once, and the rounds together read little more than the first. Afterwards the rounds are followed from the last to the first.
    """
    raw = table(edges.select(a, b).filter(F.col(a) != F.col(b)), "cc-raw")
    names, k = _numbered(raw, a, b)
    u, v = F.xxhash64(a, F.lit(k)), F.xxhash64(b, F.lit(k))
    now = table(raw.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while not now.isEmpty():
        ends = now.select(F.col("u").alias("n"), F.col("v").alias("other")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("other")))
        least = ends.groupBy("n").agg(F.min(F.xxhash64("other")).alias("least"), F.count(F.lit(1)).alias("degree"))
        own = F.least("least", F.xxhash64("n"))
        # two ends of a lone edge would change places, so leaves go to their neighbour in every other round only
        step = table(least.select("n", (F.when(F.col("degree") == 1, F.col("least")).otherwise(own) if len(steps) % 2 == 0 else own).alias("to")), "cc-step")
        # both sides are read from tables, so that the joins are plain shuffles and a node with very many edges can be split
        met = now.join(step.select(F.col("n").alias("u"), F.col("to").alias("tu")), "u").join(step.select(F.col("n").alias("v"), F.col("to").alias("tv")), "v")
        following = table(met.filter("tu <> tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct(), "cc-edges")
        gone(now)
        now = following
        steps.append(step)
    last = None
    for i in range(len(steps) - 1, -1, -1):
        if last is None:
            last = steps[i]
            continue
        # a component that was done before is not in later rounds, where its number would have been hashed on
        done = F.col("to")
        for _ in range(len(steps) - 1 - i):
            done = F.xxhash64(done)
        known = last.select(F.col("n").alias("to"), F.col("to").alias("end"))
        before, last = last, table(steps[i].join(known, "to", "left").select("n", F.coalesce("end", done).alias("to")), "cc-step")
        gone(before, steps[i])
    labels = names.select("id", F.col("n").alias("to")) if last is None else names.join(last, "n").select("id", "to")
    labels = table(labels, "cc-labels")
    least = table(labels.groupBy("to").agg(F.min("id").alias("component")), "cc-least")
    out = table(labels.join(least, "to").select("id", "component"), "cc-components")
    gone(raw, names, now, labels, least, *([last] if last is not None else []))
    return out


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes; an isolated node is its own component."""
    found = components(distinct_edges(edges))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, size, sources, sinks, pattern (linear, convergent, divergent, mesh, complex), silo (over 1 node and not the largest)."""
    c = weak_components(nodes, edges)
    d = degrees(nodes, edges).join(c, "id")
    per = d.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("in_degree") == 0).alias("sources"), F.count_if(F.col("out_degree") == 0).alias("sinks"))
    so, si = F.col("sources"), F.col("sinks")
    pattern = F.when((so == 1) & (si == 1), "linear").when((so > 1) & (si == 1), "convergent").when((so == 1) & (si > 1), "divergent").when((so > 1) & (si > 1), "mesh").otherwise("complex")
    largest = per.agg(F.max(F.struct("size", "component")).alias("top")).select(F.col("top.component").alias("largest"))
    return per.join(F.broadcast(largest)).select("component", "size", "sources", "sinks", pattern.alias("pattern"), ((F.col("size") > 1) & (F.col("component") != F.col("largest"))).alias("silo"))


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, rest): the longest-path level of every node outside and before cycles, and the edges left between the others.

    Nodes without incoming edges go round by round; a node's round is the length of the longest path that ends there.
    """
    left = table(distinct_edges(edges), "peel-edges")
    ids = table(nodes.select("id").distinct(), "peel-nodes")
    levels, level = None, 0
    while True:
        free = ids.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        free = table(free.withColumn("level", F.lit(level)), "peel-free")
        if free.isEmpty():
            break
        levels = free if levels is None else levels.unionByName(free)
        before = ids, left
        ids = table(ids.join(free, "id", "left_anti"), "peel-nodes")
        left = table(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "peel-edges")
        gone(*before)
        level += 1
    gone(ids)
    return (levels if levels is not None else free), left


def cycle_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """has_cycle, nodes_left (on or behind cycles), longest_path in nodes where there is no cycle."""
    levels, left = peel(nodes, edges)
    rest = nodes.select("id").distinct().join(levels, "id", "left_anti").agg(F.count(F.lit(1)).alias("nodes_left"))
    top = levels.agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("top"))
    return rest.join(top).select((F.col("nodes_left") > 0).alias("has_cycle"), "nodes_left", F.when(F.col("nodes_left") == 0, F.col("top")).alias("longest_path"))


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) by colouring: nodes that can't lie on a cycle go, the rest take the greatest id that reaches them, and of each colour
    what reaches its root back is one component; rounds go on with what is left."""
    left = table(distinct_edges(edges).filter("src <> dst"), "scc-edges")
    todo = table(nodes.select("id").distinct(), "scc-nodes")
    done = None
    while not todo.isEmpty():
        while True:  # trim
            both = left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")).distinct(), "id")
            kept = table(left.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "scc-edges")
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        inner = table(left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct(), "scc-inner")
        alone = todo.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))
        done = alone if done is None else done.unionByName(alone)
        todo = inner
        if todo.isEmpty():
            break
        color = table(todo.select("id", F.col("id").alias("c")), "scc-color")
        while True:
            offered = left.join(color.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.max("c").alias("m"))
            following = color.join(offered, color["id"] == offered["dst"], "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"))
            following = table(following, "scc-color")
            moved = following.join(color.withColumnRenamed("c", "old"), "id").filter("c <> old").isEmpty()
            color = following
            if moved:
                break
        own = left.join(color.withColumnRenamed("id", "src").withColumnRenamed("c", "cs"), "src").join(color.withColumnRenamed("id", "dst").withColumnRenamed("c", "cd"), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        own = table(own, "scc-own")
        seen = table(color.filter("id = c"), "scc-seen")
        front = seen
        while True:
            back = own.join(front.withColumnRenamed("id", "dst"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct().join(seen, ["id", "c"], "left_anti")
            back = table(back, "scc-back")
            if back.isEmpty():
                break
            seen, front = table(seen.unionByName(back), "scc-seen"), back
        done = done.unionByName(seen.select("id", F.col("c").alias("component")))
        todo = table(todo.join(seen.select("id"), "id", "left_anti"), "scc-nodes")
        left = table(left.join(todo.select(F.col("id").alias("src")), "src", "left_semi").join(todo.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "scc-edges")
    return done if done is not None else nodes.select("id", F.col("id").alias("component"))


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """path, length of the simple cycles, each once, from its least node; of all lengths, or up to ``longest`` nodes.

    Within a strong component every node is a root whose ways lead over greater nodes only. First the greater nodes that lead back to each root are found by
    going backwards; then ways go forward over those alone, so that no way runs into a part of the graph that has no way back. Rows are (root, node)
    pairs within components, and ways; the number of cycles can be exponential, and so can theirs.
    """
    e = distinct_edges(edges)
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    s = strong_components(e, nodes)
    inner = table(e.join(s.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b").select("src", "dst"), "cycle-edges")
    loops = inner.filter("src = dst").select(F.array("src").alias("path"))
    proper = inner.filter("src <> dst")
    levels = [table(proper.filter("src > dst").select(F.col("dst").alias("root"), F.col("src").alias("node")), "cycle-back")]
    while True:
        found = levels[-1].join(proper.withColumnRenamed("dst", "node"), "node").filter("src > root").select("root", F.col("src").alias("node")).distinct()
        for level in levels:
            found = found.join(level, ["root", "node"], "left_anti")
        levels.append(table(found, "cycle-back"))
        if levels[-1].isEmpty():
            break
    back = levels[0]
    for level in levels[1:-1]:
        back = back.unionByName(level)
    back = table(back, "cycle-ways-back")
    gone(*levels)
    paths = table(proper.filter("src < dst").select(F.col("src").alias("root"), F.col("dst").alias("node")).join(back, ["root", "node"]).select("root", F.array("root", "node").alias("path"), F.col("node").alias("tip")), "cycle-paths")
    out, length = loops, 2
    while (longest is None or length <= longest) and not paths.isEmpty():
        steps = paths.join(proper.withColumnRenamed("src", "tip"), "tip")
        out = out.unionByName(steps.filter("dst = root").select("path"))
        onward = steps.filter("dst > root").filter(~F.array_contains("path", F.col("dst"))).select("root", F.col("dst").alias("node"), "path").join(back, ["root", "node"])
        paths = table(onward.select("root", F.array_append("path", F.col("node")).alias("path"), F.col("node").alias("tip")), "cycle-paths")
        length += 1
    return out.select("path", F.size("path").alias("length"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, coefficient) on undirected edges, by ways from lower to higher degree, so that hubs don't multiply.

    Nodes go by 64-bit numbers up to the last join, and ends of degree 1, which are in no triangle, are on no way.
    """
    raw = table(edges.select("src", "dst").filter("src <> dst"), "triangle-raw")
    names, k = _numbered(raw, "src", "dst")
    u, v = F.xxhash64("src", F.lit(k)), F.xxhash64("dst", F.lit(k))
    e = table(raw.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct(), "triangle-numbers")
    deg = table(e.select(F.col("a").alias("n")).unionByName(e.select(F.col("b").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("degree")), "triangle-degrees")
    inner = deg.filter("degree > 1")
    d = e.join(inner.select(F.col("n").alias("a"), F.col("degree").alias("da")), "a").join(inner.select(F.col("n").alias("b"), F.col("degree").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = table(d.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")), "triangle-edges")
    # edges lead from lower to higher degree, so a triangle is a way of two steps and the edge from its first to its last node, and few ways go on from a hub
    ways = o.join(o.select(F.col("u").alias("v"), F.col("v").alias("w")), "v")
    tri = ways.join(o.select("u", F.col("v").alias("w")), ["u", "w"])
    per = tri.select(F.explode(F.array("u", "v", "w")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("triangles"))
    out = names.join(deg, "n").join(per, "n", "left").select("id", "degree", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))
    out = out.withColumn("coefficient", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)))
    out = table(out, "triangles")
    gone(raw, names, e, deg, o)
    return out


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


def chains(edges: DataFrame, longer: int = 4) -> DataFrame:
    """component, size of runs of nodes with one way in and out, longer than ``longer``."""
    e = distinct_edges(edges)
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    mid = degrees(nodes, e).filter("in_degree <= 1 and out_degree <= 1").select("id")
    inner = subgraph(e, mid)
    return components(inner).groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > longer)


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """downstream, upstream, risk (HIGH over 10 downstream, MEDIUM over 5, else LOW) of a set of changed ids, and its hot nodes (out over 3)."""
    down, up = reach(edges, changed), reach(edges, changed, reverse=True)
    hot = distinct_edges(edges).groupBy("src").count().filter("count > 3").join(down.select(F.col("id").alias("src")), "src", "left_semi")
    one = down.agg(F.count(F.lit(1)).alias("downstream")).join(up.agg(F.count(F.lit(1)).alias("upstream"))).join(hot.agg(F.count(F.lit(1)).alias("hot_nodes")))
    return one.withColumn("risk", F.when(F.col("downstream") > 10, "HIGH").when(F.col("downstream") > 5, "MEDIUM").otherwise("LOW"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind (edge or asset), change (added or removed), src, dst between two edge tables; an asset stands in src."""
    o, n = distinct_edges(old), distinct_edges(new)
    ids = lambda e: e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    out = None
    for change, a, b in (("added", n, o), ("removed", o, n)):
        edge = a.join(b, ["src", "dst"], "left_anti").select(F.lit("edge").alias("kind"), F.lit(change).alias("change"), "src", "dst")
        asset = ids(a).join(ids(b), "id", "left_anti").select(F.lit("asset").alias("kind"), F.lit(change).alias("change"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"))
        out = edge.unionByName(asset) if out is None else out.unionByName(edge).unionByName(asset)
    return out


def change_risk(compared: DataFrame) -> DataFrame:
    """Risk of a version difference: over 10 assets or 5 removals HIGH, over 5 or 2 MEDIUM."""
    one = compared.agg(F.count_if(F.col("kind") == "asset").alias("assets"), F.count_if((F.col("kind") == "asset") & (F.col("change") == "removed")).alias("removed"))
    return one.withColumn("risk", F.when((F.col("assets") > 10) | (F.col("removed") > 5), "HIGH").when((F.col("assets") > 5) | (F.col("removed") > 2), "MEDIUM").otherwise("LOW"))


def event_edges(events: DataFrame) -> DataFrame:
    """src, dst, operation of run events: dataset to job READ, job to dataset WRITE; of complete, running and other events."""
    done = events.filter(F.upper("event_type").isin("COMPLETE", "RUNNING", "OTHER"))
    reads = done.select(F.explode("inputs").alias("src"), F.col("job").alias("dst"), F.lit("READ").alias("operation"))
    writes = done.select(F.col("job").alias("src"), F.explode("outputs").alias("dst"), F.lit("WRITE").alias("operation"))
    return reads.unionByName(writes).dropDuplicates(["src", "dst", "operation"])


def blast_radius(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, level) of direct and second-level dependents; two levels by intent."""
    return reach(edges, changed, levels=2).withColumnRenamed("hops", "level")


def label_groups(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) by label propagation over edges in either direction; ties go to the least label.

    Nodes go by 64-bit hashes and labels by numbers in the order of the ids, so that rounds shuffle no names. In the first round all labels
    differ, so the least one wins.
    """
    raw = table(edges.select("src", "dst"), "label-raw")
    names, k = _numbered(raw, "src", "dst")
    order = _ordered(names)
    u, v = (F.when(F.col(c).isNotNull(), F.xxhash64(c, F.lit(k))) for c in ("src", "dst"))
    e = raw.select(u.alias("src"), v.alias("dst"))
    both = table(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "label-edges")
    now = order.filter("id is not null").select("n", F.col("place").alias("community"))
    for i in range(rounds):
        near = both.join(now.withColumnRenamed("n", "dst"), "dst")
        if i == 0:
            best = near.groupBy("src").agg(F.min("community").alias("community"))
        else:
            votes = near.groupBy("src", "community").count()
            best = votes.groupBy("src").agg(F.min(F.struct((-F.col("count")).alias("m"), "community")).alias("b")).select("src", F.col("b.community").alias("community"))
        before, now = now, table(best.withColumnRenamed("src", "n"), "labels")
        if i:
            gone(before)
    ids = order.filter("id is not null")
    out = now.join(ids.select("n", "id"), "n", "left").join(ids.select(F.col("place").alias("community"), F.col("id").alias("label")), "community", "left")
    return out.select("id", F.col("label").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of communities (id, community) over edges in either direction, each counted once, without loops."""
    e = distinct_edges(edges).filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    by = [labels.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in ("a", "b")]
    ends = e.join(by[0], "a").join(by[1], "b")
    inside = ends.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    totals = ends.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").count().agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"))
    return inside.join(totals).select(F.when(F.col("m") > 0, F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))).otherwise(0.0).alias("modularity"))


def _moved(links: DataFrame, now: DataFrame, whole: float, seed: int, patience: int, least_gain: float) -> tuple[DataFrame, bool, int]:
    """(state, whether a node moved, number of the last round): rounds of moves over links (a, b, w) from a state (node, k, c)."""
    idle, moved = 0, False
    while idle < patience:
        seed += 1
        takes = F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(2)) == 0
        totals = now.groupBy("c").agg(F.sum("k").alias("total"))
        there = now.select(F.col("node").alias("b"), F.col("c").alias("to"))
        weight = links.filter("a <> b").join(there, "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("l"))
        givers = now.filter(~takes).join(totals, "c")
        own = weight.withColumnRenamed("to", "c").withColumnRenamed("l", "l_own")
        asked = weight.withColumn("c", F.col("to")).filter(takes).drop("c").join(totals.select(F.col("c").alias("to"), F.col("total").alias("t_to")), "to").join(givers, "node").join(own, ["node", "c"], "left")
        gain = (F.col("l") - F.coalesce("l_own", F.lit(0.0))) / whole - F.col("k") * (F.col("t_to") - F.col("total") + F.col("k")) / whole**2
        best = asked.withColumn("gain", gain).filter(F.col("gain") > least_gain).groupBy("node", "c", "k").agg(F.min(F.struct((-F.col("gain")).alias("less"), "to")).alias("best"))
        leaves = best.groupBy("c").agg(F.min(F.struct("best.less", "node", "k", "best.to")).alias("x")).select("x.node", "x.k", "x.to", (-F.col("x.less")).alias("gain"))
        leaves = table(leaves, "community-moves")
        come = leaves.groupBy("to").agg(F.sum("k").alias("others"), F.min(F.struct((-F.col("gain")).alias("less"), "node")).alias("first"))
        fits = (F.col("gain") - F.col("k") * (F.col("others") - F.col("k")) / whole**2 > least_gain) | (F.col("node") == F.col("first.node"))
        accepted = table(leaves.join(come, "to").filter(fits).select("node", "to"), "community-moves")
        if accepted.isEmpty():
            idle += 1
            gone(leaves, accepted)
            continue
        idle, moved = 0, True
        following = table(now.join(accepted, "node", "left").select("node", "k", F.coalesce("to", "c").alias("c")), "community-state")
        gone(now, leaves, accepted)
        now = following
    return now, moved, seed


def communities(edges: DataFrame, patience: int = 3, least_gain: float = 1e-12) -> DataFrame:
    """(id, community) of the nodes of edges, in either direction, by modularity: moves round by round, then communities become nodes and it starts again.

    In each round a coin of the round's number makes every community a giver or a taker, and each node looks for the taker that gains most. Of a giver one
    node goes, the one that gains most. A taker takes every node that gains even beside all others who come to it, or else the best one alone. So each round
    raises modularity, however many nodes move at once and however many go to one community. A level ends after ``patience`` rounds without
    a move. When a level of communities has none, single nodes may move once more, until they don't either. All of it is joins and sums by
    node and community; a community is named by its least node.
    """
    spark = edges.sparkSession
    e = distinct_edges(edges).filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    links = table(e.withColumn("w", F.lit(1.0)).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1.0).alias("w"))), "community-links")
    names = table(links.select(F.col("a").alias("id"), F.col("a").alias("community")).distinct(), "communities")
    whole = links.agg(F.sum("w")).first()[0] or 0.0
    seed, moved = 0, bool(whole)

    def merged(level: DataFrame, now: DataFrame) -> DataFrame:
        to = [now.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in ("a", "b")]
        return table(level.join(to[0], "a").join(to[1], "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "community-links")

    while moved:
        degree = links.groupBy("a").agg(F.sum("w").alias("k"))
        state = table(degree.join(names.select(F.col("id").alias("a"), "community"), "a").select(F.col("a").alias("node"), "k", F.col("community").alias("c")), "community-state")
        now, moved, seed = _moved(links, state, whole, seed, patience, least_gain)
        if not moved:
            gone(now)
            break
        gone(names)
        names, level = table(now.select(F.col("node").alias("id"), F.col("c").alias("community")), "communities"), merged(links, now)
        gone(now)
        again = True
        while again:
            state = table(level.groupBy("a").agg(F.sum("w").alias("k")).select(F.col("a").alias("node"), "k", F.col("a").alias("c")), "community-state")
            now, again, seed = _moved(level, state, whole, seed, patience, least_gain)
            if again:
                renamed = table(names.join(now.select(F.col("node").alias("community"), "c"), "community").select("id", F.col("c").alias("community")), "communities")
                following = merged(level, now)
                gone(names, level)
                names, level = renamed, following
            gone(now)
        gone(level)
    least = names.groupBy("community").agg(F.min("id").alias("least"))
    return names.join(least, "community").select("id", F.col("least").alias("community"))


def downstream_sizes(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, downstream): how many other nodes each node (or each id of ``of``) leads to, for all of them at once, exact.

    Rows are pairs of a node and one that it reaches, as 64-bit numbers, found a hop a round: what is new in a round meets the edges, and what was found before goes.
    So its work grows with the number of such pairs, which can be the square of the nodes; none of it is in one place. A node on a cycle doesn't count itself.
    """
    raw = table(distinct_edges(edges), "size-edges")
    names, k = _numbered(raw, "src", "dst")
    numbers = raw.select(F.xxhash64("src", F.lit(k)).alias("a"), F.xxhash64("dst", F.lit(k)).alias("b"))
    e = table(numbers.filter("a <> b"), "size-numbers")
    first = e.select(F.col("a").alias("s"), F.col("b").alias("v"))
    if of is not None:
        first = first.join(of.select(F.xxhash64("id", F.lit(k)).alias("s")).distinct(), "s", "left_semi")
    levels = [table(first, "size-pairs")]
    while not levels[-1].isEmpty():
        found = levels[-1].join(e, F.col("v") == F.col("a")).select("s", F.col("b").alias("v")).filter("s <> v").distinct()
        levels.append(table(found.join(together(*levels), ["s", "v"], "left_anti"), "size-pairs"))
    counted = together(*levels).groupBy(F.col("s").alias("n")).agg(F.count(F.lit(1)).alias("downstream"))
    nodes = names if of is None else names.join(of.select("id").distinct(), "id", "left_semi")
    out = table(nodes.join(counted, "n", "left").select("id", F.coalesce("downstream", F.lit(0)).cast("long").alias("downstream")), "sizes")
    gone(raw, names, e, *levels)
    return out


def _forest(both: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """Breadth-first levels (id, parent) from the roots over ``both``, which has every edge in both directions; of equally near parents the least."""
    levels = [table(roots.select("id", F.lit(None).cast(dict(both.dtypes)["src"]).alias("parent")), "forest-level")]
    while True:
        found = levels[-1].select("id").join(both, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        for level in levels[-2:]:  # neighbours are at most one level away
            found = found.join(level.select("id"), "id", "left_anti")
        found = table(found, "forest-level")
        if found.isEmpty():
            return levels
        levels.append(found)


#: Edges a node from which blocks are first looked for among some of the edges.
DENSE = 8


def _blocks(e: DataFrame, nodes: int) -> DataFrame:
    """(id, parent, level, block) of all nodes but the roots of a forest, for undirected edges (a, b) of numbers, a table; block names that of the edge to the parent.

    Of a dense graph some edges, chosen by hash, are taken first. An edge within one of their blocks changes no block and goes, and a block counts only by its nodes, so
    each is replaced by edges from two of its nodes to all others. With the edges that are left, which are few, that graph has the blocks of the whole one.
    """
    many = e.count()
    if many <= DENSE * nodes:
        return _tree_blocks(e)
    chosen = F.pmod(F.xxhash64("a", "b", F.lit("some")), F.lit(1 << 20)) < F.lit(int((nodes / many) ** 0.5 * (1 << 20)))
    some = table(e.filter(chosen), "cut-some")
    found = _tree_blocks(some)
    top = found.groupBy("block").agg(F.min(F.struct("level", "parent")).alias("highest"), F.min("id").alias("second")).select("block", F.col("highest.parent").alias("top"), "second")
    own = table(found.join(top, "block").select("id", "block", "top", "second"), "cut-own")
    ends = [own.select(F.col("id").alias(x), F.col("block").alias(f"block_{x}"), F.col("top").alias(f"top_{x}")) for x in ("a", "b")]
    within = (F.col("block_a") == F.col("block_b")) | (F.col("top_a") == F.col("b")) | (F.col("top_b") == F.col("a"))
    left = e.filter(~chosen).join(ends[0], "a", "left").join(ends[1], "b", "left").filter(~F.coalesce(within, F.lit(False))).select("a", "b")
    star = own.select(F.least("top", "id").alias("a"), F.greatest("top", "id").alias("b")).unionByName(own.filter("id <> second").select(F.least("second", "id").alias("a"), F.greatest("second", "id").alias("b")))
    thin = table(star.unionByName(left), "cut-thin")
    out = _tree_blocks(thin)
    gone(some, found, own, thin)
    return out


def _trees(e: DataFrame, both: DataFrame) -> list[DataFrame]:
    """``_forest`` of all components: from the node with most edges, and if that doesn't reach all nodes, from such a node of every other component."""
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    most = F.max(F.struct("degree", "src")).alias("root")
    levels = _forest(both, degree.agg(most).filter("root is not null").select(F.col("root.src").alias("id")))
    rest = table(e.join(together(*levels).select(F.col("id").alias("a")), "a", "left_anti").select("a", "b"), "forest-rest")
    if not rest.isEmpty():
        parts = components(rest, "a", "b")
        more = _forest(both, degree.join(parts.withColumnRenamed("id", "src"), "src").groupBy("component").agg(most).select(F.col("root.src").alias("id")))
        apart = levels, more
        levels = [table(together(*[x[k] for x in apart if k < len(x)]), "forest-level") for k in range(max(map(len, apart)))]
        gone(parts, *apart[0], *more)
    gone(rest)
    return levels


def _tree_blocks(e: DataFrame) -> DataFrame:
    """``_blocks`` by a breadth-first tree of every component, from its node with most edges.

    An edge beside the tree closes a cycle through the two ways up to where they meet, and the tree's edges on one cycle can't be cut apart. So pairs of ways climb
    a level a round until they meet and link each tree edge (named by its lower node) with the next; linked edges are blocks. All of it is joins; the rounds are the
    depth of the trees, and a round's rows at most the edges.
    """
    both = table(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "cut-edges")
    levels = _trees(e, both)
    tree = levels[0].withColumn("level", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        tree = tree.unionByName(level.withColumn("level", F.lit(k)))
    tree = table(tree, "cut-tree")
    up = tree.select(F.col("id").alias("a"), F.col("parent").alias("p"), F.col("level").alias("k"))
    down = tree.select(F.col("id").alias("b"), F.col("parent").alias("q"), F.col("level").alias("m"))
    met = e.join(up, "a").join(down, "b").filter("not (p <=> b) and not (q <=> a)")
    first = F.col("k") <= F.col("m")
    met = met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("q"), F.least("k", "m").alias("k"), F.greatest("k", "m").alias("m"))
    beside = table(met, "cut-beside")
    own = beside.filter("k < m").select("k", F.col("q").alias("x"), F.col("x").alias("y"))  # the lower end climbs first
    level_pairs = own.unionByName(beside.filter("k = m").select("k", "x", "y")).select("k", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    links = beside.select(F.col("x").alias("src"), F.col("y").alias("dst")).unionByName(beside.filter("k < m").select(F.col("y").alias("src"), F.col("q").alias("dst")))
    climbing, used = None, [both, beside, *levels]
    for k in range(len(levels) - 1, 0, -1):
        pairs = level_pairs.filter(F.col("k") == k).select("x", "y")
        pairs = (pairs if climbing is None else pairs.unionByName(climbing)).distinct()
        over = levels[k].select(F.col("id").alias("x"), F.col("parent").alias("p")), levels[k].select(F.col("id").alias("y"), F.col("parent").alias("q"))
        apart = table(pairs.join(over[0], "x").join(over[1], "y").filter("p <> q"), "cut-apart")
        used.append(apart)
        for lower, upper in (("x", "p"), ("y", "q")):
            links = links.unionByName(apart.select(F.col(lower).alias("src"), F.col(upper).alias("dst")).distinct())
        climbing = apart.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    linked = components(links)
    out = table(tree.filter("level > 0").join(linked, "id", "left").select("id", "parent", "level", F.coalesce("component", "id").alias("block")), "cut-blocks")
    gone(*used, tree, linked)
    return out


def articulation_points(edges: DataFrame) -> DataFrame:
    """id of the nodes whose loss splits their component, in either direction of the edges; loops don't count. A node in more than one block is a point."""
    raw = table(edges.select("src", "dst").filter("src <> dst"), "cut-raw")
    names, k = _numbered(raw, "src", "dst")
    u, v = F.xxhash64("src", F.lit(k)), F.xxhash64("dst", F.lit(k))
    e = table(raw.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct(), "cut-numbers")
    lower = _blocks(e, names.count())
    member = lower.select(F.col("id").alias("n"), "block").unionByName(lower.select(F.col("parent").alias("n"), "block")).distinct()
    out = table(member.groupBy("n").count().filter("count > 1").join(names, "n").select("id"), "cut-points")
    gone(raw, names, e, lower)
    return out


def failure_points(edges: DataFrame) -> DataFrame:
    """(id, downstream) of the nodes whose loss splits their component, with how many nodes each leads to, by ``downstream_sizes``."""
    points = table(articulation_points(edges), "failure-points")
    return points.join(downstream_sizes(edges, points), "id")


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, score) of shortest paths from the given (or all) sources through each node, by Brandes' sums per source.

    All sources go forward together, a level a round: a row is a source, a node and the number of shortest ways to it. Then the levels go back and
    hand their dependencies to the nodes before them. Both are joins with the edges, so neither the graph nor a source's part of it is ever in one place;
    the rows are the pairs of sources and what they reach.
    """
    names, e = _placed(edges)
    first = e.select(F.col("a").alias("s"), F.col("b").alias("v"), F.lit(1.0).alias("ways"))
    if sources is not None:
        first = first.join(names.join(sources.select("id").distinct(), "id", "left_semi").select(F.col("place").alias("s")), "s", "left_semi")
    levels = [table(first, "between-level")]
    while not levels[-1].isEmpty():
        # only rows of nodes that edges lead to from here can have been found before
        ahead = table(levels[-1].select(F.col("v").alias("a")).distinct().join(e, "a").select(F.col("b").alias("v")).distinct(), "between-ahead")
        found = levels[-1].join(e, F.col("v") == F.col("a")).filter("s <> b").groupBy("s", F.col("b").alias("v")).agg(F.sum("ways").alias("ways"))
        earlier = together(*levels).select("s", "v").join(ahead, "v", "left_semi")
        levels.append(levels[-1].limit(0) if ahead.isEmpty() else table(found.join(earlier, ["s", "v"], "left_anti"), "between-level"))
        gone(ahead)
    # the last level is empty, the one before it hands on what it is
    below, parts = levels[max(0, len(levels) - 2)].withColumn("part", F.lit(0.0)), []
    for level in reversed(levels[:-2]):
        # nodes without a way on stay in with a part of 0, so a level needn't meet its sums again
        step = level.join(e, F.col("v") == F.col("a"), "left").select("s", "v", "ways", F.col("b").alias("x"))
        handed = step.join(below.select("s", F.col("v").alias("x"), F.col("ways").alias("wx"), "part"), ["s", "x"], "left")
        own = F.sum(F.coalesce(F.col("ways") / F.col("wx") * (1 + F.col("part")), F.lit(0.0)))
        below = table(handed.groupBy("s", "v", "ways").agg(own.alias("part")), "between-parts")
        parts.append(below)
    if not parts:
        return names.limit(0).select("id", F.lit(0.0).alias("score"))
    scores = together(*parts).filter("part > 0").groupBy(F.col("v").alias("place")).agg(F.sum("part").alias("score"))
    out = table(scores.join(names, "place").select("id", "score"), "between-scores")
    gone(e, *(x for x in levels if hasattr(x, "scratch_path")), *parts)
    return out


def independent_paths(edges: DataFrame, longest: int = 10, most: int | None = 10) -> DataFrame:
    """source, sink, path of ways from nodes without incoming to nodes without outgoing edges that share no node; the first ``most`` by (source, sink).

    Each pair offers its shortest way of two to ``longest`` edges, the least of equally long ones, and pairs choose in their order. A way that is the first
    at all of its nodes is chosen whatever the others do, so all such ways are taken at once, what touches them goes, and rounds go on with the rest.
    """
    names, e = _placed(edges)
    loops = table(edges.filter("src = dst").select(F.col("src").alias("id")).distinct(), "way-loops")
    # a node with a loop is neither a start nor a sink
    looped = names.join(loops, "id", "left_semi").select("place")
    starts = e.select(F.col("a").alias("id")).distinct().join(e.select(F.col("b").alias("id")).unionByName(looped.select(F.col("place").alias("id"))), "id", "left_anti")
    sinks = e.select(F.col("b").alias("sink")).distinct().join(e.select(F.col("a").alias("sink")).unionByName(looped.select(F.col("place").alias("sink"))), "sink", "left_anti")
    begun = e.join(starts.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("a").alias("source"), F.col("b").alias("sink"), F.array("a", "b").alias("path"))
    levels = [table(begun, "way-level")]
    while len(levels) < longest and not levels[-1].isEmpty():
        found = levels[-1].join(e, F.col("sink") == F.col("a")).groupBy("source", F.col("b").alias("sink")).agg(F.min(F.array_append("path", F.col("b"))).alias("path"))
        # only rows of nodes that edges lead to from here can have been found before
        ahead = table(levels[-1].select(F.col("sink").alias("a")).distinct().join(e, "a").select(F.col("b").alias("sink")).distinct(), "way-ahead")
        earlier = together(*levels).select("source", "sink").join(ahead, "sink", "left_semi")
        levels.append(table(found.join(earlier, ["source", "sink"], "left_anti"), "way-level"))
        gone(ahead)
    left = together(*levels[1:]) if len(levels) > 1 else levels[0].limit(0)
    left = table(left.join(sinks, "sink", "left_semi").select("source", "sink", "path"), "ways")
    gone(e, loops, *levels)
    chosen = []
    while not left.isEmpty():
        at = left.select("source", "sink", F.explode("path").alias("node"))
        first = at.groupBy("node").agg(F.min(F.struct("source", "sink")).alias("way")).groupBy("way.source", "way.sink").agg(F.count(F.lit(1)).alias("nodes"))
        taken = table(left.join(first, ["source", "sink"]).filter(F.col("nodes") == F.size("path")).select("source", "sink", "path"), "ways-taken")
        chosen.append(taken)
        used = taken.select(F.explode("path").alias("node"), F.lit(True).alias("used"))
        each = left.select("source", "sink", "path", F.explode("path").alias("node")).join(used, "node", "left")
        kept = each.groupBy("source", "sink", "path").agg(F.max(F.coalesce("used", F.lit(False))).alias("used")).filter("not used")
        before, left = left, table(kept.select("source", "sink", "path"), "ways")
        gone(before)
    out = together(*chosen) if chosen else left
    out = out if most is None else out.orderBy("source", "sink").limit(most)
    steps = out.select("source", "sink", F.posexplode("path").alias("step", "place")).join(names, "place")
    path = F.transform(F.array_sort(F.collect_list(F.struct("step", "id"))), lambda x: x["id"])
    out = steps.groupBy("source", "sink").agg(path.alias("path")).select(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("sink"), "path")
    return out if most is None else out.orderBy("source", "sink")


def complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, density, cyclic, components, complexity band and parallel share in percent.

    Points: nodes over 20, 50, 100; cycles 2; density over .15, .3; more than 3 components. The share starts at 30 with several sources or sinks, else 10, and
    grows with low density and several components, to 90 at most.
    """
    m = metrics(nodes, edges).join(cycle_summary(nodes, edges)).join(weak_components(nodes, edges).agg(F.countDistinct("component").alias("components")))
    ends = roles(nodes, edges).agg(F.count_if("source").alias("sources"), F.count_if("sink").alias("sinks"))
    m = m.join(ends)
    n, dens, parts = F.col("nodes"), F.col("density"), F.col("components")
    points = F.when(n > 100, 3).when(n > 50, 2).when(n > 20, 1).otherwise(0) + F.when(F.col("has_cycle"), 2).otherwise(0) + F.when(dens > 0.3, 2).when(dens > 0.15, 1).otherwise(0) + F.when(parts > 3, 1).otherwise(0)
    band = F.when(points >= 6, "very high").when(points >= 4, "high").when(points >= 2, "moderate").otherwise("low")
    share = F.when((F.col("sources") > 1) | (F.col("sinks") > 1), 30).otherwise(10) + F.when(dens < 0.1, 40).when(dens < 0.2, 20).otherwise(0) + F.when(parts > 1, 20).otherwise(0)
    return m.select("nodes", "density", F.col("has_cycle").alias("cyclic"), "components", band.alias("band"), F.when(n == 0, 0).otherwise(F.least(share, F.lit(90))).alias("parallel_percent"))


def task_metrics(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """dag, tasks, width (most tasks with equally many dependencies), bottlenecks (over 3 in or out), sources, sinks of tables of tasks and edges per dag."""
    e = edges.select("dag", "src", "dst").distinct()
    fan_in = e.groupBy("dag", F.col("dst").alias("task")).agg(F.count(F.lit(1)).alias("i"))
    fan_out = e.groupBy("dag", F.col("src").alias("task")).agg(F.count(F.lit(1)).alias("o"))
    t = tasks.select("dag", "task").distinct().join(fan_in, ["dag", "task"], "left").join(fan_out, ["dag", "task"], "left").select("dag", "task", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o"))
    width = t.groupBy("dag", "i").count().groupBy("dag").agg(F.max("count").alias("width"))
    per = t.groupBy("dag").agg(F.count(F.lit(1)).alias("tasks"), F.count_if((F.col("i") > 3) | (F.col("o") > 3)).alias("bottlenecks"), F.count_if(F.col("i") == 0).alias("sources"), F.count_if(F.col("o") == 0).alias("sinks"))
    return per.join(width, "dag")


def clusters(nodes: DataFrame, parts: int = 1) -> DataFrame:
    """cluster, nodes: nodes grouped by the first parts of their dotted (or colon) names."""
    name = F.array_join(F.slice(F.split("id", "[.:]"), 1, parts), ".")
    return nodes.groupBy(name.alias("cluster")).agg(F.count(F.lit(1)).alias("nodes"))


def component_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component and the longest common beginning of its nodes' names: that of the least and the greatest name."""
    per = weak_components(nodes, edges).groupBy("component").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    prefix = F.expr("array_max(transform(filter(sequence(0, least(length(a), length(z))), k -> substring(a, 1, k) = substring(z, 1, k)), k -> k))")
    return per.select("component", F.expr("a").substr(F.lit(1), prefix).alias("prefix"))


def code_references(files: DataFrame, text: str = "text") -> DataFrame:
    """file, kind, name of tables that code reads and writes: spark.table and saveAsTable calls, CREATE, INSERT and MERGE targets, resources."""
    kinds = {
        "read": r"""spark\.(?:read\.)?table\(\s*["']([\w.]+)["']""", "save": r"""saveAsTable\(\s*["']([\w.]+)["']""", "create": r"(?i)create\s+(?:or\s+replace\s+)?table\s+([\w.]+)",
        "insert": r"(?i)insert\s+(?:into|overwrite)\s+(?:table\s+)?([\w.]+)", "merge": r"(?i)merge\s+into\s+([\w.]+)", "resource": r'resource\s+"[\w-]+"\s+"([\w-]+)"',
    }

    def hits(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("name")))

    each = [hits(k, p) for k, p in kinds.items()]
    return files.select("file", F.inline(F.flatten(F.array(*each)))).distinct()


def top_nodes(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return degrees(nodes, edges).filter("degree > 2").orderBy(F.desc("degree"), "id").limit(n)


def layer_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Distinct pairs of layers that edges join, with their number; layers: id, layer."""
    a, b = layers.select(F.col("id").alias("src"), F.col("layer").alias("from_layer")), layers.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer"))
    return distinct_edges(edges).join(a, "src").join(b, "dst").groupBy("from_layer", "to_layer").agg(F.count(F.lit(1)).alias("edges"))


def ranked(df: DataFrame, score: str, key: str) -> DataFrame:
    """rank by score, the greatest first, ties by key, without gathering rows: ranges of the order are numbered apart, each from where those before it
    end. There are as many ranges as shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(score), F.asc(key)]
    dealt = table(df.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("range").orderBy(*order))
    return dealt.withColumn("own", own).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "range")


def dominant_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, size, dominant_type, share: the type that most nodes of a component have (the least name in a tie; null is no type).

    nodes: id, type. Nodes are counted by component and type first, so that a giant component is as many rows as it has types.
    """
    per = weak_components(nodes, edges).join(nodes.select("id", "type").distinct(), "id").groupBy("component", "type").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("type").alias("t"))))
    return per.groupBy("component").agg(F.sum("n").alias("size"), best.alias("b")).select("component", "size", F.col("b.t").alias("dominant_type"), (-F.col("b.m") / F.col("size")).alias("share"))


def percentile(df: DataFrame, column: str, p: float, accuracy: int = 10000) -> DataFrame:
    """One row, n and limit: the exact percentile with linear interpolation; limit is null where there are no values.

    A sketch brackets the rank, a second pass counts what lies below and sums up the few values in the bracket, so nothing has to be sorted or held but
    some 4 / accuracy of the different values. Nulls are no values.
    """
    v = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    low, high = max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)
    ends = v.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", low, accuracy).alias("lo"), F.percentile_approx("v", high, accuracy).alias("hi"))
    w = v.join(F.broadcast(ends))
    # the neighbours of the bracket stand for a rank that lies just outside it, as ranks of small tables may
    inside = w.filter("v between lo and hi").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    outside = w.agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.max(F.when(F.col("v") < F.col("lo"), F.col("v"))).alias("before"), F.min(F.when(F.col("v") > F.col("hi"), F.col("v"))).alias("after"))
    run = inside.withColumn("upto", F.sum("c").over(W.orderBy("v")))
    rank = p * (F.col("n") - 1)
    at = lambda r: F.min(F.when(F.col("below") + F.col("upto") > r, F.col("v")))
    both = run.join(F.broadcast(ends.select("n"))).join(F.broadcast(outside))
    one = both.agg(F.max("n").alias("n"), F.max("below").alias("below"), F.max("before").alias("before"), F.max("after").alias("after"), at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b"))
    a = F.when(F.floor(rank) < F.col("below"), F.col("before")).otherwise(F.coalesce("a", "after"))
    b = F.when(F.ceil(rank) < F.col("below"), F.col("before")).otherwise(F.coalesce("b", "after"))
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), (a + (b - a) * (rank - F.floor(rank))).alias("limit"))


def above(df: DataFrame, column: str, p: float) -> DataFrame:
    """The rows over the column's percentile, which a second column, limit, tells."""
    return df.join(F.broadcast(percentile(df, column, p).select("limit"))).filter(F.col(column) > F.col("limit"))


def dense_spots(nodes: DataFrame, edges: DataFrame, p: float = 0.8, degree: int = 5) -> DataFrame:
    """id, degree (in and out), coefficient, limit of nodes whose clustering is over the percentile and whose degree is over ``degree``."""
    found = clustering(edges).select("id", "coefficient")
    per = degrees(nodes, edges).select("id", F.col("degree")).join(found, "id", "left").withColumn("coefficient", F.coalesce("coefficient", F.lit(0.0)))
    # the percentile reads its values several times
    per = table(per, "dense-spots")
    return above(per, "coefficient", p).filter(F.col("degree") > degree)


# Words in nodes' names and what they call a component, and its purpose; the first that is found counts.
TITLES = {
    "etl": "ETL Pipeline", "transform": "Transformation Layer", "staging": "Staging Area", "raw": "Raw Data Ingestion", "aggregate": "Aggregation Pipeline",
    "dim": "Dimension Tables", "fact": "Fact Tables", "report": "Reporting Layer", "ml": "ML Pipeline",
}
PURPOSES = {
    "extract": "Data extraction from source systems", "transform": "Data transformation and enrichment", "load": "Data loading into target systems", "validate": "Data quality validation and checks",
    "aggregate": "Data aggregation and summarization", "join": "Data integration and joining", "filter": "Data filtering and selection", "clean": "Data cleansing and standardization",
    "enrich": "Data enrichment with additional attributes", "stage": "Data staging for further processing", "archive": "Data archival and historical storage", "report": "Report generation and visualization",
    "ml": "Machine learning pipeline", "feature": "Feature engineering for ML", "model": "Model training or scoring",
}


def component_titles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, size, title (a shared beginning of over three letters, else the first word found, else the size) and purpose; a flag a word, no names gathered."""
    c = weak_components(nodes, edges)
    low = F.lower("id")
    words = list(dict.fromkeys([*TITLES, *PURPOSES]))
    per = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"), *[F.max(low.contains(w)).alias(f"w_{w}") for w in words])
    per = per.join(component_names(nodes, edges), "component")
    first = lambda m: F.coalesce(*[F.when(F.col(f"w_{w}"), F.lit(v)) for w, v in m.items()])
    shared = F.when((F.col("size") > 1) & (F.length("prefix") > 3), F.concat(F.btrim("prefix", F.lit("_.-")), F.lit(" Component")))
    return per.select("component", "size", F.coalesce(shared, first(TITLES), F.format_string("Component (%d nodes)", "size")).alias("title"), F.coalesce(first(PURPOSES), F.lit("Data processing and transformation")).alias("purpose"))
