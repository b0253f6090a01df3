"""Retrieval queries: benchmark items ask the documents, every fiftieth vector asks all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.functions.scratch import table
from govlens.operators import discovery as r
from govlens.operators.workflow import contexts as contexts_of
from govlens.sources.tables import read


def idf_terms(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    out = r.idf(r.terms(docs), docs.count())
    return out.orderBy(F.desc("idf"), "term").limit(100).select("term", "df", F.round("idf", 9).alias("idf"))


def document_frequencies(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return r.idf(r.terms(docs), docs.count()).select("term", "df", F.round("idf", 9).alias("idf"))


def lexical(spark, d):
    items, postings = _asked(spark, d)
    # documents a task: its sums are one a document and item
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, d, "documents").count() // 10_000))
    return r.lexical_scores(items, postings, parts=parts).select("item_id", "doc_id", F.round("lexical", 6).alias("lexical"))


def _asked(spark, d):
    """Weights of the items, and of their terms in the documents."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    asked = r.terms(read(spark, d, "benchmark"), key="item_id")
    idfs, postings = r.asked_postings(docs, asked, docs.count())
    return r.weights(asked, idfs, key="item_id"), postings


def standards(spark, d):
    """The five best English documents of each item, from a score of 0.3 on."""
    items, postings = _asked(spark, d)
    english = read(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    out = r.lexical_top(items, postings.join(english, "doc_id", "left_semi"), 5, min_score=0.3)
    return out.select("item_id", "doc_id", "lexical", "rank", r.relevance(F.col("lexical")).alias("relevance"))


def contexts(spark, d):
    """The beginnings (80 characters, the feature's own length) of the three best documents of each language for every item, as one text."""
    items, postings = _asked(spark, d)
    docs = read(spark, d, "documents").select("doc_id", "lang", F.substring("text", 1, 80).alias("text"))
    best = r.lexical_best(items, postings, 3, docs.select("doc_id", F.col("lang").alias("kind"))).join(docs, "doc_id")
    return contexts_of(best, "item_id", "lang", "text")


_TF = """n AS (SELECT count(*) AS n FROM documents), stop AS (SELECT [{stop}] AS s),
  ws AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{2,}}'), lambda x: NOT list_contains(s, x)) AS w FROM documents, stop),
  w AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM ws), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
  idf AS (SELECT term, count(*) AS df, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) <= n * 0.95),
  dw AS (SELECT doc_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY doc_id)) AS w FROM tf JOIN idf USING (term))""".format(stop=", ".join(f"'{s}'" for s in r.STOPWORDS))
_LEX = f"""{_TF}, qs AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda x: NOT list_contains(s, x)) AS w FROM benchmark, stop),
  qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM qs) GROUP BY ALL),
  qw AS (SELECT item_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY item_id)) AS w FROM qt JOIN idf USING (term)),
  lx AS (SELECT item_id, doc_id, round(sum(qw.w * dw.w), 6) AS lexical FROM qw JOIN dw USING (term) GROUP BY ALL)"""


def _asking(spark, d):
    e = read(spark, d, "embeddings")
    return e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def nearest(spark, d):
    e, asks = _asking(spark, d)
    return r.nearest(asks, e, 10).select("query_id", "vec_id", "rank")


def nearest_filtered(spark, d):
    e, asks = _asking(spark, d)
    return r.nearest(asks, e, 10, keep=F.col("label") == 1).select("query_id", "vec_id", "rank")


_NEAR = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  p AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM u a, u b WHERE a.vec_id % 50 = 0 {where}),
  near AS (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS rank FROM p)"""


def nearest_indexed(spark, d):
    """The ten nearest by the index of centres: all vectors are in it, two thirds of the centres are probed for each query."""
    e, asks = _asking(spark, d)
    c = r.centres(e, 24)
    return r.nearest_indexed(asks, r.indexed(e, c), c, 10, probes=16).select("query_id", "vec_id", "rank")


def importance(spark, d):
    return r.importance(read(spark, d, "documents")).withColumn("importance", F.round("importance", 9))


def _hybrid(spark, d):
    """Candidates of the vector search, with the text scores of the documents under the vectors' ids."""
    e, asks = _asking(spark, d)
    near = table(r.nearest(asks, e, 30), "discovery-near")
    docs = read(spark, d, "documents")
    texts = docs.select("doc_id", "text")
    # frequencies are those of all documents, weights only those of the candidates
    ids = near.select(F.col("query_id").alias("doc_id")).unionByName(near.select(F.col("vec_id").alias("doc_id"))).distinct()
    # dealt by id: the vectors' ids are those of the first documents, which lie in a few parts of the file
    own = r.weights(r.counted_terms(texts.join(ids, "doc_id", "left_semi").repartition("doc_id")), r.frequencies(texts, docs.count()))
    lex = r.candidate_scores(near, table(own, "discovery-weights").withColumnRenamed("doc_id", "id"), "query_id", "vec_id")
    return table(r.hybrid(near, lex, r.importance(docs).withColumnRenamed("doc_id", "vec_id"), "query_id", "vec_id"), "discovery-hybrid"), e


def hybrid(spark, d):
    return _hybrid(spark, d)[0].select("query_id", "vec_id", F.round("score", 6).alias("score"))


def diverse(spark, d):
    ranked, e = _hybrid(spark, d)
    return r.suppress(ranked, e, "query_id", "vec_id", limit=0.95)


def mmr(spark, d):
    ranked, e = _hybrid(spark, d)
    return r.mmr(ranked, e, "query_id", "vec_id")


def upserts(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("v"), "l_quantity")
    return r.latest(rows, "id", "v", deleted=read(spark, d, "part").filter("p_size % 5 = 0").select(F.col("p_partkey").alias("id")))


def unindexed(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    index = docs.filter("doc_id % 3 = 0").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content_id"))
    return r.unindexed(docs, index).select("doc_id", "content_id")


QUERIES = {
    "discovery_idf_terms": idf_terms, "discovery_document_frequencies": document_frequencies, "discovery_lexical": lexical, "discovery_nearest": nearest, "discovery_nearest_filtered": nearest_filtered, "discovery_nearest_indexed": nearest_indexed, "discovery_importance": importance,
    "discovery_hybrid": hybrid, "discovery_diverse": diverse, "discovery_mmr": mmr, "discovery_upserts": upserts, "discovery_unindexed": unindexed,
    "discovery_standards": standards, "discovery_contexts": contexts,
}

_SCORED = f"""{_TF}, {_NEAR.format(where='')}, iw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents), x AS (SELECT doc_id AS vec_id, (len(w) + len(list_distinct(w))) / max(len(w) + len(list_distinct(w))) OVER () AS imp FROM iw),
  c AS (SELECT query_id, vec_id, distance FROM near WHERE rank <= 30), ls AS (SELECT query_id, vec_id, sum(a.w * b.w) AS lexical FROM c JOIN dw a ON a.doc_id = query_id JOIN dw b ON b.doc_id = vec_id AND b.term = a.term GROUP BY ALL),
  sc AS (SELECT query_id, vec_id, 0.7 * (1 - least(distance / 2, 1)) + 0.2 * coalesce(lexical, 0) + 0.1 * coalesce(imp, 0) AS score FROM c LEFT JOIN ls USING (query_id, vec_id) LEFT JOIN x USING (vec_id)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM sc)"""

ORACLE = {
    "discovery_idf_terms": f"WITH {_TF} SELECT term, df, round(idf, 9) AS idf FROM idf ORDER BY idf.idf DESC, term LIMIT 100",
    "discovery_document_frequencies": f"WITH {_TF} SELECT term, df, round(idf, 9) AS idf FROM idf",
    "discovery_lexical": f"WITH {_LEX} SELECT * FROM lx",
    "discovery_standards": f"""WITH {_LEX}, k AS (SELECT item_id, doc_id, lexical, row_number() OVER (PARTITION BY item_id ORDER BY lexical DESC, doc_id) AS rank FROM lx JOIN documents USING (doc_id) WHERE lang = 'en' AND lexical >= 0.3)
      SELECT *, CASE WHEN lexical > 0.7 THEN 'high' WHEN lexical > 0.4 THEN 'medium' ELSE 'low' END AS relevance FROM k WHERE rank <= 5""",
    "discovery_contexts": f"""WITH {_LEX}, k AS (SELECT item_id, lang, substr(text, 1, 80) AS t, row_number() OVER (PARTITION BY item_id, lang ORDER BY lexical DESC, doc_id) AS rank FROM lx JOIN documents USING (doc_id))
      SELECT item_id, string_agg(t, chr(10) ORDER BY lang, rank) AS context FROM k WHERE rank <= 3 GROUP BY 1""",
    "discovery_nearest": f"WITH {_NEAR.format(where='')} SELECT query_id, vec_id, rank FROM near WHERE rank <= 10",
    "discovery_nearest_filtered": f"WITH {_NEAR.format(where='AND b.label = 1')} SELECT query_id, vec_id, rank FROM near WHERE rank <= 10",
    "discovery_importance": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents), x AS (SELECT doc_id, len(w) + len(list_distinct(w)) AS raw FROM w)
      SELECT doc_id, round(raw / max(raw) OVER (), 9) AS importance FROM x""",
    "discovery_hybrid": f"WITH {_SCORED} SELECT query_id, vec_id, round(score, 6) AS score FROM sc",
    "discovery_upserts": """WITH r AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS v, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) AS k FROM lineitem)
      SELECT id, v, l_quantity FROM r WHERE k = 1 AND id NOT IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0)""",
    "discovery_unindexed": "SELECT doc_id, md5(coalesce(text, '')) AS content_id FROM documents WHERE md5(coalesce(text, '')) NOT IN (SELECT md5(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)",
}
