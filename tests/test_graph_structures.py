"""Communities, cycles of any length and downstream sizes against brute force on small graphs."""

import itertools
import os
import random
from collections import defaultdict

import pytest

from govlens.functions.scratch import shared_dir
from govlens.operators import graph


def frame(spark, edges):
    return spark.createDataFrame([(a, b) for a, b in edges], "src string, dst string")


def simple_cycles(edges):
    out, next_ = set(), defaultdict(set)
    for a, b in edges:
        next_[a].add(b)

    def walk(path):
        for x in next_[path[-1]]:
            if x == path[0]:
                out.add(tuple(path))
            elif x > path[0] and x not in path:
                walk([*path, x])

    for a in list(next_):
        walk([a])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_of_any_length(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(20)} | {("r0", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r4"), ("r4", "r5"), ("r5", "r6"), ("r6", "r0"), ("n0", "r0")}
    want = simple_cycles(edges)
    got = [tuple(r.path) for r in graph.cycles(frame(spark, edges)).collect()]
    assert sorted(got) == sorted(want) and max(map(len, want)) >= 7
    assert {tuple(r.path) for r in graph.cycles(frame(spark, edges), longest=3).collect()} == {c for c in want if len(c) <= 3}


def test_no_cycles(spark):
    assert graph.cycles(frame(spark, [("a", "b"), ("b", "c"), ("a", "c")])).count() == 0 and graph.cycles(frame(spark, [])).count() == 0


def quality(edges, community):
    e = {tuple(sorted(x)) for x in edges if x[0] != x[1]}
    m, degree = len(e), defaultdict(int)
    for a, b in e:
        degree[community[a]] += 1
        degree[community[b]] += 1
    return sum(community[a] == community[b] for a, b in e) / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def greedy(edges):
    """Merges the two communities that gain most until none gains."""
    community = {x: x for e in edges for x in e}
    best = quality(edges, community)
    while True:
        options = []
        for a, b in itertools.combinations(sorted(set(community.values())), 2):
            merged = {k: a if v == b else v for k, v in community.items()}
            options.append((quality(edges, merged), merged))
        top = max(options, key=lambda x: x[0], default=(best, None))
        if top[0] <= best + 1e-12:
            return best
        best, community = top


def planted(rng, groups, size, inside, between):
    edges = set()
    for a, b in itertools.combinations(range(groups * size), 2):
        if rng.random() < (inside if a // size == b // size else between):
            edges.add((f"n{a:02}", f"n{b:02}") if rng.random() < 0.5 else (f"n{b:02}", f"n{a:02}"))
    return sorted(edges)


def test_communities(spark):
    # dense groups, and a hub that many nodes join at once
    edges = [*planted(random.Random(4), 3, 5, 0.9, 0.05), *[("hub", f"leaf{i}") for i in range(6)], ("hub", "n00"), ("leaf0", "leaf0")]
    df = frame(spark, edges)
    rows = graph.communities(df, patience=2).collect()
    found = {r.id: r.community for r in rows}
    assert len(rows) == len(found) == len({x for e in edges for x in e})
    assert all(c == min(k for k, v in found.items() if v == c) for c in found.values())
    own = quality(edges, found)
    assert own >= greedy(edges) - 1e-9
    assert abs(graph.modularity(df, spark.createDataFrame(rows)).first()[0] - own) < 1e-12


def test_communities_of_nothing(spark):
    assert graph.communities(frame(spark, [])).count() == 0 and graph.communities(frame(spark, [("a", "a")])).count() == 0
    assert graph.modularity(frame(spark, []), graph.communities(frame(spark, []))).first()[0] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_downstream_sizes(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)} | {("n1", "n1")}
    next_ = defaultdict(set)
    for a, b in edges:
        next_[a].add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for x in next_[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return len(seen - {a})

    nodes = {x for e in edges for x in e}
    assert {r.id: r.downstream for r in graph.downstream_sizes(frame(spark, edges)).collect()} == {a: reach(a) for a in nodes}


def test_downstream_sizes_of_many(spark):
    wide = spark.range(20_000).selectExpr("'root' as src", "concat('x', id) as dst").unionByName(spark.createDataFrame([("top", "root")], "src string, dst string"))
    got = {r.id: r.downstream for r in graph.downstream_sizes(wide).filter("id in ('root', 'top', 'x1')").collect()}
    assert abs(got["root"] - 20_000) < 0.05 * 20_000 and abs(got["top"] - 20_001) < 0.05 * 20_000 and got["x1"] == 0


def test_loops_leave_their_result_alone(spark):
    chain = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)])
    left = lambda: set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()
    before = left()
    found = graph.reach(chain, spark.createDataFrame([("n0",)], "id string"))
    assert sorted((r.id, r.hops) for r in found.collect()) == [(f"n{i}", i) for i in range(1, 7)] and len(left() - before) == 1
    assert graph.reach(chain, spark.createDataFrame([("n9",)], "id string")).count() == 0 and len(left() - before) == 2
    assert {r.id for r in graph.reach(chain, spark.createDataFrame([("n0",)], "id string"), levels=2).collect()} == {"n1", "n2"}
    before = left()
    levels, rest = graph.peel(spark.createDataFrame([(f"n{i}",) for i in range(7)], "id string"), chain)
    assert {(r.id, r.level) for r in levels.collect()} == {(f"n{i}", i) for i in range(7)} and rest.count() == 0
    assert len(left() - before) == 9  # a table a level, the last, empty one, and the edges that are left
