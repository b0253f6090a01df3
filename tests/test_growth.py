"""What round 3's findings were about: whole results, whatever the number of rows, without pairs that nobody asked for."""

import math
import os
import random

from pyspark.sql import functions as F

from govlens.functions.scratch import shared_dir
from govlens.llm import minhash
from govlens.operators import discovery, governance, graph, links, workflow
from govlens.plans import further
from tests.test_operators import cut_points


def test_text_search_has_no_limit(spark, monkeypatch):
    # more models than the constant that the query once had
    parts = spark.range(100_050).selectExpr("id AS p_partkey", "'x' AS p_name", "'y' AS p_type", "'Brand#1' AS p_brand", "2 AS p_size")
    monkeypatch.setattr(further, "read", lambda *_: parts)
    assert further.registry_text_search(spark, "").count() == 100_050


def test_search_models_still_takes_the_first(spark):
    m = spark.createDataFrame([(3, "a", "", None, []), (1, "A", "", None, []), (2, "b", "", None, ["a"])], "model_id int, name string, purpose string, description string, tags array<string>")
    assert [r.model_id for r in links.search_models(m, "a", limit=2).collect()] == [1, 2]
    assert {r.model_id for r in links.search_models(m, "a", limit=None).collect()} == {1, 2, 3}


def test_inventory_has_the_least_neighbours(spark):
    # the first neighbours in order come from one pass, not from joins of all edges with themselves
    rng = random.Random(5)
    edges = {(f"a:{rng.randrange(12)}", f"b:{rng.randrange(30)}") for _ in range(150)}
    df = spark.createDataFrame([*edges, *list(edges)[:9]], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in {x for e in edges for x in e}], "id string")
    got = {r.id: r for r in links.graph_inventory(nodes, df, neighbours=4).collect()}
    for n in {x for e in edges for x in e}:
        ins, outs = sorted(a for a, b in edges if b == n), sorted(b for a, b in edges if a == n)
        assert (n in got) == (len(ins) > 5 or len(outs) > 5)
        if n in got:
            assert (got[n].inputs, got[n].outputs, got[n].in_degree, got[n].out_degree) == (ins[:4], outs[:4], len(ins), len(outs))


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_changes_are_counted_without_pairs(spark):
    # F8: some changes and some rules have several rows, blanks meet nothing
    rng = random.Random(6)
    some = lambda k: rng.choice([None, *(f"v{i}" for i in range(k))])
    rules = [(rng.randrange(40), some(5), some(6)) for _ in range(70)]
    changes = [(rng.randrange(60), some(6), some(7)) for _ in range(60)]
    got = links.rules_per_change(spark.createDataFrame(changes, "change int, dataset string, attribute string"), spark.createDataFrame(rules, "rule int, dataset string, attribute string"))
    want = {}
    for c, d, a in changes:
        want.setdefault(c, set()).update(r for r, rd, ra in rules if (d is not None and rd == d) or (a is not None and ra == a))
    assert {r.change: r.rules for r in got.collect()} == {c: len(v) for c, v in want.items() if v}


def test_impacted_rules_are_those_of_all_pairs(spark):
    # pairs of rules and changes of one row each aren't made distinct, those of others are
    rng = random.Random(7)
    some = lambda k: rng.choice([None, *(f"v{i}" for i in range(k))])
    rules = [(rng.choice([None, *range(40)]), some(5), some(6)) for _ in range(60)]
    changes = [(rng.choice([None, *range(40)]), some(6), some(7)) for _ in range(50)]
    got = workflow.impacted_rules(spark.createDataFrame(rules, "rule int, dataset string, attribute string"), spark.createDataFrame(changes, "change int, dataset string, attribute string")).collect()
    want = {(r, c) for r, rd, ra in rules for c, d, a in changes if (d is not None and rd == d) or (a is not None and ra == a)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_single_pairs_are_not_shuffled(spark):
    rules = spark.range(50).selectExpr("id AS rule", "'d' || (id % 3) AS dataset", "'a' || (id % 4) AS attribute")
    changes = spark.range(30).selectExpr("id AS change", "'d' || (id % 5) AS dataset", "'a' || (id % 7) AS attribute")
    plan = workflow.impacted_rules(rules, changes)._jdf.queryExecution().optimizedPlan()
    assert plan.getClass().getSimpleName() == "Union" and plan.children().head().getClass().getSimpleName() != "Aggregate"


def test_pairs_take_little_room(spark, tmp_path):
    # F1 of round 4: equal runs of changes follow one another, so what is written is less than half a byte a pair (before: 0.7 here, 4.6 with 120,000 changes)
    rules = spark.range(2_000).selectExpr("id AS rule", "'r' AS dataset", "'a' || (id % 2) AS attribute")
    changes = spark.range(4_000).selectExpr("id AS change", "'c' AS dataset", "'a' || (id % 2) AS attribute")
    workflow.impacted_rules(rules, changes).write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.count() == pairs.distinct().count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").rglob("*.parquet")) < 0.5 * 4_000_000


def test_cut_points_of_dense_graphs(spark, monkeypatch):
    # F4, F2 of round 4: of dense graphs only some edges are put in trees; blocks, bridges and components are those of all edges, and no step has nearly all edges
    rng = random.Random(11)
    pairs = [(f"p{i}", f"s{s}") for i in range(60) for s in rng.sample(range(25), 20)]
    pairs += [(f"q{i}", f"t{t}") for i in range(30) for t in rng.sample(range(14), 12)]
    pairs += [("p1", "bridge"), ("bridge", "q1"), ("s2", "leaf"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w")]
    written, write = [], graph.table
    monkeypatch.setattr(graph, "table", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    monkeypatch.setattr(graph, "gone", lambda *_: None)
    found = sorted(r.id for r in graph.articulation_points(spark.createDataFrame(pairs, "src string, dst string")).collect())
    assert found == ["bridge", "p1", "q1", "s2", "z"]
    most = max(t.count() for name, t in written if name == "cut-beside")
    assert most < 0.7 * len(pairs)


def test_cut_points_from_some_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "DENSE", 1)
    rng, pairs = random.Random(12), []
    for g in range(40):
        n = rng.randint(4, 14)
        pairs += [(f"{g:02d}-{rng.randrange(n)}", f"{g:02d}-{rng.randrange(n)}") for _ in range(rng.randint(n, 3 * n))]
    assert {r.id for r in graph.articulation_points(spark.createDataFrame(pairs, "src string, dst string")).collect()} == cut_points(pairs)


def test_names_within_catalog_names(spark):
    # parts of names of any length, also fewer than four characters, each with the least name that has it
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab.") for _ in range(rng.randint(1, n)))
    catalog, found = [word(14) for _ in range(40)], ["", *[word(7) for _ in range(150)], "aaaaaaaaaaaaaaaaaaaaaaaa"]
    got = {r.name: (r.match, r.confidence) for r in governance.resolve_names(spark.createDataFrame([(c,) for c in catalog], "name string").select("name"), spark.createDataFrame([(c,) for c in catalog], "name string")).collect()}
    assert all(v == (k, "high") for k, v in got.items())
    got = {r.name: (r.match, r.confidence) for r in governance.resolve_names(spark.createDataFrame([(c,) for c in found], "name string"), spark.createDataFrame([(c,) for c in catalog], "name string")).collect()}
    last = lambda x: x.rsplit(".", 1)[-1]
    for n in set(found):
        if n and n not in catalog and not any(c.endswith("." + n) or last(c) == last(n) for c in catalog):
            inside = min((c for c in catalog if n in c), default=None)
            assert got[n] == (inside, "low" if inside else None), n


def test_names_meet_no_catalog_name_by_its_beginning(spark):
    f, c = spark.createDataFrame([("main.q",)], "name string"), spark.createDataFrame([("main.x",)], "name string")
    assert "Contains(" not in _joins(governance.resolve_names(f, c)) and "contains(" not in _joins(governance.resolve_names(f, c)).lower().replace("array_contains(", "")


def test_components_of_any_shape(spark):
    # stars, chains, lone edges, cycles and names in any order, against a plain search
    rng = random.Random(9)
    edges = [("hub", f"leaf{i}") for i in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("p", "q"), ("z", "z"), (None, "n")]
    edges += [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(60)] + [("q", "p")]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    near = {}
    for a, b in edges:
        if a and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = start
                todo += near[n]
    assert got == want
    assert graph.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_components_leave_their_result_alone(spark):
    left = lambda: set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()
    before = left()
    graph.components(spark.createDataFrame([(f"n{i}", f"n{i // 2}") for i in range(1, 30)], "src string, dst string"))
    assert len(left() - before) == 1


def _documents(spark, rng, n):
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "of", "e", "Ff", "gg_1", "hh"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "aa aa aa")], "doc_id int, text string"), n + 2


def test_asked_postings_are_those_of_all_weights(spark):
    # postings of asked terms alone, at the length that all terms of a document give
    docs, n = _documents(spark, random.Random(10), 40)
    asked = spark.createDataFrame([("aa",), ("bb cc",), ("aa",), ("zz",), ("gg_1",)], "term string")
    tf = discovery.terms(docs)
    idfs = discovery.idf(tf, n)
    want = {(r.doc_id, r.term): r.w for r in discovery.weights(tf, idfs).join(asked.distinct(), "term").collect()}
    found, postings = discovery.asked_postings(docs, asked, n)
    got = {(r.doc_id, r.term): r.w for r in postings.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {(r.term, r.df, round(r.idf, 9)) for r in found.collect()} == {(r.term, r.df, round(r.idf, 9)) for r in idfs.join(asked.distinct(), "term").collect()}


def test_lexical_scores_do_not_shuffle_products(spark):
    # sums by item and document come after one shuffle of the postings by document
    docs, n = _documents(spark, random.Random(11), 40)
    asked = discovery.terms(docs.filter("doc_id < 5").withColumnRenamed("doc_id", "item_id"), key="item_id")
    idfs, postings = discovery.asked_postings(docs, asked, n)
    scores = discovery.lexical_scores(discovery.weights(asked, idfs, key="item_id"), postings, parts=4)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" not in plan and "hashpartitioning(doc_id" in plan
    assert all(0 < r.lexical < 1 + 1e-9 for r in scores.collect())


def test_downstream_sizes_are_exact(spark):
    # more nodes than a sketch tells apart, and only those that are asked for
    wide = spark.range(6_000).selectExpr("concat('r', id % 2) AS src", "concat('x', id) AS dst").unionByName(spark.createDataFrame([("top", "r0"), ("top", "r1"), ("r1", "top"), ("me", "me")], "src string, dst string"))
    got = {r.id: r.downstream for r in graph.downstream_sizes(wide).filter("id not like 'x%' or id = 'x1'").collect()}
    assert got == {"r0": 3_000, "r1": 6_002, "top": 6_002, "me": 0, "x1": 0}
    some = graph.downstream_sizes(wide, spark.createDataFrame([("r0",), ("me",)], "id string"))
    assert {tuple(r) for r in some.collect()} == {("r0", 3_000), ("me", 0)}


def test_clustering_goes_on_from_hubs_alone(spark):
    # many leaves of several hubs make as many ways as edges, not all pairs of their hubs; triangles against a plain count
    rng = random.Random(12)
    pairs = {tuple(rng.sample(range(25), 2)) for _ in range(110)} | {(i, i) for i in range(3)} | {(100 + i, 200 + j) for i in range(40) for j in range(12)}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    got = {r.id: (r.degree, r.triangles) for r in graph.clustering(e).collect()}
    assert got == {f"n{x}": (len(o), sum(b in near[a] for a in o for b in o if a < b)) for x, o in near.items()}
    made = spark._jsparkSession.sharedState().statusStore()
    assert _most_joined(made) < 2_000  # 40 * 12 * 11 / 2 pairs of hubs before


def _most_joined(store):
    """The most rows that a join of the last executions made."""
    runs, most = store.executionsList(), 0
    for i in range(max(0, runs.size() - 12), runs.size()):
        k = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for n in [nodes.apply(j) for j in range(nodes.size())]:
            for m in [n.metrics().apply(j) for j in range(n.metrics().size())] if "Join" in n.name() else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_large_buckets_carry_their_size_classes(spark, monkeypatch):
    # op9: rows of large buckets don't meet their nodes again to learn sizes
    rng = random.Random(13)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(words)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    seen, across = [], minhash._across
    monkeypatch.setattr(minhash, "_across", lambda hot, *rest: seen.append(hot.select("node", "size").distinct().collect()) or across(hot, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs, block=4).collect()} <= set(range(30))
    assert seen and len({r.node for r in seen[0]}) == len(seen[0]) and all(r["size"] == math.floor(math.log(56) / -math.log(0.85)) for r in seen[0])


def test_betweenness_against_plain_sums(spark):
    # cycles, loops, given sources, and rows by number instead of by name
    rng = random.Random(14)
    pairs = {(f"n{rng.randrange(16)}", f"n{rng.randrange(16)}") for _ in range(34)}
    near = {}
    for a, b in sorted(pairs):
        near.setdefault(a, set()).update({b} - {a})

    def plain(starts):
        out = {}
        for s in starts:
            ways, front, order = {s: 1}, {s: 1}, []
            while front:
                order.append(front)
                following = {}
                for v, w in front.items():
                    for x in near.get(v, ()):
                        if x not in ways:
                            following[x] = following.get(x, 0) + w
                ways |= following
                front = following
            part = {}
            for here, after in list(zip(order, order[1:], strict=False))[::-1]:
                for v in here:
                    part[v] = sum(ways[v] / ways[x] * (1 + part.get(x, 0)) for x in near.get(v, ()) if x in after)
            for v, p in part.items():
                if v != s and p:
                    out[v] = out.get(v, 0) + p
        return {k: round(v, 9) for k, v in out.items()}

    e = spark.createDataFrame(sorted(pairs), "src string, dst string")
    assert {r.id: round(r.score, 9) for r in graph.betweenness(e).collect()} == plain(near)
    some = spark.createDataFrame([("n1",), ("n2",), ("none",)], "id string")
    found = graph.betweenness(e, some)
    assert {r.id: round(r.score, 9) for r in found.collect()} == plain([x for x in ("n1", "n2") if x in near])
    assert "scores" in found._jdf.inputFiles()[0]  # a table: percentiles read it several times


def test_ordered_numbers_follow_the_ids(spark):
    # F14, F25
    ids = spark.range(3_000).selectExpr("concat('k', id * 7919 % 3001) AS id").distinct().withColumn("n", F.xxhash64("id"))
    rows = sorted((r.place, r.id) for r in graph._ordered(ids).collect())
    assert len(rows) == len({p for p, _ in rows}) and [i for _, i in rows] == sorted(i for _, i in rows)


def test_document_counts_are_those_of_terms(spark):
    # words cut, lower-cased and paired as the plain way does, over texts that end within words, in one piece or many
    odd = ["\u212aelvin \u0130ab\u0130x \u0131i", "a_b 1 22 the of x9", "", None, "AA aa Aa bb", "aa", "aa bb", "éaaÉbb aa", "zz\nthe\tzz", " of ", "\u0130", "yy", "zz yy", "the"]
    docs = spark.createDataFrame(list(enumerate([*odd, *odd[:5], "aa bb " * 3000])), "doc_id int, text string").repartition(2).cache()
    n = docs.count()
    want = {(r.term, r.df, r.idf) for r in discovery.idf(discovery.terms(docs), n).collect()}
    assert {t for t, _, _ in want} >= {"kelvin", "kelvin abi", "abi", "aa bb", "a_b 22", "zz zz"}
    each = {tuple(r) for r in discovery.terms(docs).select("doc_id", "term", "tf").collect()}
    for hold in (1, 40, discovery.HOLD):
        found = discovery.counted_terms(docs, hold=hold).select("doc_id", "term", "tf").collect()
        assert {tuple(r) for r in found} == each and len(found) == len(each)
        assert {(r.term, r.df, r.idf) for r in discovery.frequencies(docs, n, hold=hold).collect()} == want
    assert discovery.frequencies(docs.filter("doc_id in (2, 3, 9)"), 3).count() == 0 and discovery.frequencies(docs.limit(0), 0).count() == 0


def test_weights_count_frequencies_once(spark):
    # the lengths come with the weights, and a text is searched for its words once
    docs, n = _documents(spark, random.Random(13), 30)
    plan = _joins(discovery.weights(discovery.terms(docs), discovery.frequencies(docs, n)))
    assert plan.count("MapInArrow") + plan.count("Generate explode") == 2 and plan.count("regexp_extract_all") == 1


def test_hybrid_rank_takes_near_equal_scores_as_ties(spark):
    # as in its SQL: sums in another order don't change the rank
    near = spark.createDataFrame([(0, 7, 0.3 + 1e-15), (0, 5, 0.3), (0, 9, 0.3 - 2e-15)], "query_id int, vec_id int, distance double")
    none = spark.createDataFrame([], "query_id int, vec_id int, lexical double")
    ranked = discovery.hybrid(near, none, spark.createDataFrame([], "vec_id int, importance double"), "query_id", "vec_id")
    assert [r.vec_id for r in ranked.orderBy("rank").collect()] == [5, 7, 9]


def test_nodes_with_shingles_of_their_own_meet_no_crowd(spark, monkeypatch):
    # the check's finding on operator 9: many changed copies, which link with nobody, don't meet all of a large bucket
    rng = random.Random(14)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 7])):
            w[k] = f"x{i}_{k}"
        docs.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in docs}
    want = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = want[i], want[j]
                want = {k: min(a, b) if v in (a, b) else v for k, v in want.items()}
    met, across = [], minhash._across
    monkeypatch.setattr(minhash, "_across", lambda hot, *rest: met.append(hot.select("node").distinct().count()) or across(hot, *rest))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=8).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    far = sum(len(s - set().union(*(o for j, o in sets.items() if j != i))) * 100 > 15 * len(s) for i, s in sets.items())
    assert far > 5 and met and met[0] <= len(docs) - far
