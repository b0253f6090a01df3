"""Vector and lexical top-k against brute force: ties, nulls, several blocks, hot terms, kinds."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from govlens.operators import discovery
from govlens.plans import discovery as plans


def vectors(spark, n, dims=8, seed=1):
    rng = random.Random(seed)
    rows = [(f"d{i:04}", [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(f"t{i}", rows[i % 5][1]) for i in range(40)] + [("zero", [0.0] * dims), ("none", None)]
    return rows, spark.createDataFrame(rows, "vec_id string, embedding array<float>").repartition(5)


def nearest(rows, queries, k):
    unit = {i: np.asarray(v, np.float32).astype(float) for i, v in rows if v is not None}
    unit = {i: v / np.linalg.norm(v) if v.any() else v for i, v in unit.items()}
    return {(q, i, n) for q in queries for n, (_, i) in enumerate(sorted((round(1 - float(unit[q] @ v), 12), i) for i, v in unit.items())[:k], 1)}


@pytest.mark.parametrize("block, broadcast", [(2000, discovery.BROADCAST), (7, discovery.BROADCAST), (7, -1)])
def test_nearest_is_exact(spark, monkeypatch, block, broadcast):
    rows, df = vectors(spark, 300)
    monkeypatch.setattr(discovery, "BROADCAST", broadcast)
    queries = [r[0] for r in rows[:30]] + ["zero"]
    asks = df.filter(F.col("vec_id").isin(queries) | (F.col("vec_id") == "none")).withColumnRenamed("vec_id", "query_id")
    got = discovery.nearest(asks, df, 12, block=block)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == nearest(rows, queries, 12)
    assert discovery.nearest(asks, df.limit(0), 3).count() == 0 and discovery.nearest(asks.limit(0), df, 3).count() == 0
    only = {(r.query_id, r.vec_id) for r in discovery.nearest(asks, df, 3, keep=F.col("vec_id").startswith("t")).collect()}
    assert len(only) == 3 * len(queries) and all(i.startswith("t") for _, i in only)


def test_index_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    asks = df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    whole = {(r.query_id, r.vec_id) for r in discovery.nearest(asks, df, 10).collect()}
    c = discovery.centres(df, 24)
    index = discovery.indexed(df, c)
    assert index.count() == df.count()
    found = {(r.query_id, r.vec_id) for r in discovery.nearest_indexed(asks, index, c, 10, probes=16).collect()}
    assert len(found & whole) >= 0.9 * len(whole) and len(found) == len(whole)
    every = {(r.query_id, r.vec_id) for r in discovery.nearest_indexed(asks, index, c, 10, probes=len(c)).collect()}
    assert every == whole


def test_no_nested_loops(spark):
    _, df = vectors(spark, 50)
    asks = df.withColumnRenamed("vec_id", "query_id")
    plan = discovery.nearest(asks, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def corpus(spark, seed):
    """Texts in which one word is nearly everywhere, some rare ones, and equal texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(["common"] * rng.randint(0, 3) + rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 12))), rng.choice("ab")) for i in range(200)]
    docs += [(200 + i, docs[i][1], "b") for i in range(10)] + [(300, None, "a"), (301, "", "b")]
    items = [(i, " ".join(["common"] + rng.choices(vocabulary, k=rng.randint(1, 6)))) for i in range(25)] + [(25, "common"), (26, "unseen words"), (27, None)]
    return docs, items


def weights(texts, idf):
    out = {}
    for k, t in texts:
        w = (t or "").split()
        tf = Counter(x for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))] if x in idf)
        norm = math.sqrt(sum((n * idf[x]) ** 2 for x, n in tf.items()))
        out[k] = {x: n * idf[x] / norm for x, n in tf.items()}
    return out


@pytest.mark.parametrize("n, least, by_kind, first", [(3, 0.0, False, 0.5), (3, 0.3, False, 0.9), (2, 0.0, True, 0.5), (500, 0.0, False, 0.5), (1, 0.0, True, 0.05)])
def test_lexical_top(spark, n, least, by_kind, first):
    docs, items = corpus(spark, n)
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    idfs = discovery.frequencies(df, df.count())
    assert {(r.term, r.df) for r in idfs.collect()} == {(r.term, r.df) for r in discovery.idf(discovery.terms(df), df.count()).collect()}
    postings, queries = discovery.weights(discovery.terms(df), idfs), discovery.weights(discovery.terms(asked, key="item_id"), idfs, key="item_id")
    kinds = df.select("doc_id", "kind") if by_kind else None
    got = {(r.item_id, r.doc_id, r["rank"]): r.lexical for r in discovery.lexical_top(queries, postings, n, min_score=least, kinds=kinds, first=first).collect()}
    idf = {r.term: r.idf for r in idfs.collect()}
    dw, qw = weights([d[:2] for d in docs], idf), weights(items, idf)
    want, kind = {}, {d[0]: d[2] for d in docs}
    for i, q in qw.items():
        groups = defaultdict(list)
        for d, w in dw.items():
            if common := q.keys() & w.keys():
                score = round(sum(q[x] * w[x] for x in common), 6)
                if score >= least:
                    groups[kind[d] if by_kind else ""].append((-score, d))
        for g in groups.values():
            want.update({(i, d, r): -s for r, (s, d) in enumerate(sorted(g)[:n], 1)})
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_frequent_terms_bring_no_candidates(spark):
    docs, items = corpus(spark, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    asked = spark.createDataFrame([x for x in items if x[0] < 25], "item_id long, text string")
    idfs = discovery.frequencies(df, df.count())
    postings, queries = discovery.weights(discovery.terms(df), idfs), discovery.weights(discovery.terms(asked, key="item_id"), idfs, key="item_id")
    own = queries.select("item_id", "term", F.col("w").alias("wq")).join(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("top")), "term")
    pairs = discovery._candidates(own, postings, own.select("item_id").distinct().withColumn("least", F.lit(0.6)), "item_id", "doc_id").count()
    assert pairs < discovery.lexical_scores(queries, postings).count() / 3


@pytest.mark.parametrize("n, cells", [(3, discovery.CELLS), (2, 90), (500, 1)])
def test_lexical_best_is_lexical_top(spark, n, cells):
    # F3 of round 4: the best of each kind without candidates, also where a document's postings lie in several batches
    docs, items = corpus(spark, 40 + n)
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else k) for i, t, k in docs], "doc_id long, text string, kind string").repartition(3)
    asked = discovery.terms(spark.createDataFrame(items, "item_id long, text string"), key="item_id")
    idfs, postings = discovery.asked_postings(df, asked, df.count())
    queries, kinds = discovery.weights(asked, idfs, key="item_id"), df.select("doc_id", "kind")
    rows = lambda x: {(r.item_id, r.kind, r.doc_id, r["rank"], round(r.lexical, 5)) for r in x.collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = rows(discovery.lexical_best(queries, postings, n, kinds, cells=cells))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == rows(discovery.lexical_top(queries, postings, n, kinds=kinds)) and any(k is None for _, k, *_ in got)


def test_contexts_bring_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(discovery, "_candidates", None)
    assert plans.contexts(spark, "/root/testdata/sf0.001").count() > 0


def test_postings_of_repeated_keys(spark):
    rows = [(1, "aa bb"), (1, "bb cc bb"), (2, "bb"), (3, None), (3, "aa"), (4, "dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([("bb",), ("aa bb",), ("aa",)], "term string")
    found, postings = discovery.asked_postings(df, asked, len(rows))
    idfs = discovery.idf(discovery.terms(df), len(rows))
    assert {(r.term, r.df) for r in found.collect()} == {(r.term, r.df) for r in idfs.collect() if r.term in ("aa", "bb", "aa bb")}
    want = {(r.doc_id, r.term): round(r.w, 9) for r in discovery.weights(discovery.terms(df), idfs).collect() if r.term in ("aa", "bb", "aa bb")}
    assert {(r.doc_id, r.term): round(r.w, 9) for r in postings.collect()} == want
