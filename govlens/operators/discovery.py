"""Retrieval over documents: TF-IDF, vector similarity, hybrid ranking, diversity and standards search, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, LongType

from govlens.functions.scratch import table

#: English and Portuguese words that carry no subject.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "de", "do", "e", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


#: Terms (or terms of queries) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000


def _worded(docs: DataFrame, *keys: str, text: str = "text", stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """keys and words: those of a text without stop words, as a column of its own, so that the terms made of it don't search the text again."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z0-9_]{2,}"), F.lit(0)), lambda w: ~w.isin(list(stop)))
    return docs.select(*keys, words.alias("words"))


def _grams(bigrams: bool = True) -> Column:
    """The words of ``_worded`` and pairs of neighbours."""
    words = F.col("words")
    if not bigrams:
        return words
    fewer = F.greatest(F.size(words) - 1, F.lit(0))
    pair = F.zip_with(F.slice(words, 1, fewer), F.slice(words, 2, fewer), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(F.size(words) > 1, pair).otherwise(F.array().cast("array<string>")))


def terms(docs: DataFrame, key: str = "doc_id", text: str = "text", stop: Sequence[str] = STOPWORDS, bigrams: bool = True) -> DataFrame:
    """key, term, tf: words of two ASCII letters or digits and more, lower-cased, without stop words, and pairs of neighbours."""
    return _worded(docs, key, text=text, stop=stop).select(key, F.explode(_grams(bigrams)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


#: Bytes of text whose terms a task counts at a time.
HOLD = 8 << 20
#: Lower-cased bytes of words, 0 for all others.
_FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _FOLD[[_c, ord(chr(_c).upper())]] = _c


def _counts(hold: int, keyed: bool, listed: bool = False):
    """mapInArrow function over texts, ``hold`` bytes at a time: terms and how many of these texts have them, or with keys each text's terms and how often it has them.

    Listed, a term comes once with the keys and counts of all of these texts that have it.
    """

    def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of ``_worded`` and the number of each one's text; beyond ASCII, only the two signs whose lower case begins in ASCII count."""
        texts = pc.replace_substring(pc.replace_substring(pc.fill_null(texts, ""), "\u212a", "k"), "\u0130", "i\u0307")
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]]
        off -= off[0]
        word = data != 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        begins, ends = off[off < len(data)], off[off > 0] - 1  # a text's end ends a word
        first[begins], last[ends] = word[begins], word[ends]
        starts = np.flatnonzero(first)
        length = np.flatnonzero(last) + 1 - starts
        places = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[word]))
        own = pa.array(length >= 2)
        own = pc.and_(own, pc.invert(pc.is_in(words, value_set=pa.array(STOPWORDS))))
        return words.filter(own), (np.searchsorted(off, starts, "right") - 1)[own.to_numpy(zero_copy_only=False)]

    def counted(keys: list[pa.Array], texts: list[pa.Array]) -> pa.RecordBatch:
        texts_ = pa.concat_arrays(texts)
        words, of = words_of(texts_)
        coded = words.dictionary_encode()
        known, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        near = of[1:] == of[:-1]
        # a word is its number, a pair of neighbours the number of both
        term, at = np.unique(np.concatenate((code, len(known) + code[:-1][near] * len(known) + code[1:][near])), return_inverse=True)
        single = int(np.searchsorted(term, len(known)))
        left, right = np.divmod(term[single:] - len(known), max(1, len(known)))
        pairs = pc.binary_join_element_wise(known.take(pa.array(left)), known.take(pa.array(right)), " ")
        terms_ = pa.concat_arrays([known.take(pa.array(term[:single])), pairs])
        every = np.concatenate((of, of[1:][near]))
        if listed:
            places = np.sort(at * len(texts_) + every)
            first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))[: len(places)])
            own, text = np.divmod(places[first], max(1, len(texts_)))
            docs = pa.StructArray.from_arrays([pa.concat_arrays(keys).take(pa.array(text)), pa.array(np.diff(np.append(first, len(places))))], ["key", "n"])
            starts = np.searchsorted(own, np.arange(len(term) + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([terms_, pa.ListArray.from_arrays(pa.array(starts), docs)], ["term", "docs"])
        places = np.sort(every * len(term) + at)
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))[: len(places)])
        text, own = np.divmod(places[first], max(1, len(term)))
        if not keys:
            return pa.RecordBatch.from_arrays([terms_, pa.array(np.bincount(own, minlength=len(term)).astype(np.int64))], ["term", "n"])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(pa.array(text)), terms_.take(pa.array(own)), pa.array(np.diff(np.append(first, len(places))))], ["key", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        for b in batches:
            texts.append(b.column("text"))
            if keyed:
                keys.append(b.column("key"))
            held += b.column("text").nbytes
            if held >= hold:
                yield counted(keys, texts)
                keys, texts, held = [], [], 0
        if texts:
            yield counted(keys, texts)

    return run


def counted_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", hold: int = HOLD) -> DataFrame:
    """key, term, tf as of ``terms``, counted on Arrow buffers; nothing is shuffled if docs come dealt by key."""
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_counts(hold, True), f"key {kind}, term string, n long")
    return own.groupBy("key", "term").agg(F.sum("n").alias("tf")).withColumnRenamed("key", key)


def frequencies(docs: DataFrame, n: int, text: str = "text", max_df: float = 0.95, hold: int = HOLD) -> DataFrame:
    """term, df, idf as of ``idf``, straight from texts: each text gives a term once, so nothing is shuffled but sums by term. Rows are documents."""
    per = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counts(hold, False), "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return per.filter(F.col("df") <= n * max_df).withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def idf(tf: DataFrame, n: int | Column, max_df: float = 0.95, key: str = "doc_id") -> DataFrame:
    """term, df, idf (smooth) of the terms that at most ``max_df`` of the documents have."""
    n = F.lit(n) if isinstance(n, int) else n
    per = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return per.filter(F.col("df") <= n * max_df).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def weights(tf: DataFrame, idfs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, w: tf times idf, of length one per document; terms without idf fall away."""
    raw = tf.join(idfs.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))  # in the same pass: a second one would count all frequencies again
    return raw.select(key, "term", (F.col("raw") / norm).alias("w"))


def asked_postings(docs: DataFrame, asked: DataFrame, n: int, max_df: float = 0.95, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, df, idf of the asked terms; key, term, w as of ``weights`` of those alone) of n documents.

    Every term counts for a document's length, but only asked ones are handed on. So each term is shuffled once for some megabytes of texts, with the documents
    that have it, to where its frequency is counted, and what comes back of all others is one sum a document and task.
    """
    asked = table(asked.select("term").distinct(), "asked-terms")
    known = asked.select("term", F.lit(True).alias("asked"))
    known = F.broadcast(known) if asked.count() <= BROADCAST_TERMS else known
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # rows that share a key are one document, whose terms are summed up first
    again = table(docs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("again")), "asked-again")
    several = not again.isEmpty()
    once = docs.join(again, F.col("key").eqNullSafe(F.col("again")), "left_anti") if several else docs
    tf = once.mapInArrow(_counts(HOLD, True, listed=True), f"term string, docs array<struct<key:{kind},n:bigint>>")
    if several:
        more = docs.join(again, F.col("key").eqNullSafe(F.col("again")), "left_semi").mapInArrow(_counts(HOLD, True), f"key {kind}, term string, n long").groupBy("key", "term").agg(F.sum("n").alias("n"))
        tf = tf.unionByName(more.select("term", F.array(F.struct("key", "n")).alias("docs")))
    tf = tf.repartition("term").withColumn("df", F.sum(F.size("docs")).over(W.partitionBy("term"))).filter(F.col("df") <= n * max_df)
    idf_ = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    tf = tf.join(known, "term", "left").select(F.when(F.col("asked"), F.col("term")).alias("term"), "df", idf_.alias("idf"), F.explode("docs").alias("doc"))
    raw = tf.select(F.col("doc.key").alias(key), "term", "df", "idf", (F.col("doc.n") * F.col("idf")).alias("raw"))
    own = table(raw.groupBy(key, "term").agg(F.sum(F.col("raw") * F.col("raw")).alias("square"), F.max("raw").alias("raw"), F.max("df").alias("df"), F.max("idf").alias("idf")), "asked-weights")
    norms = own.groupBy(key).agg(F.sqrt(F.sum("square")).alias("norm"))
    own = own.filter("term is not null")
    return own.groupBy("term").agg(F.max("df").alias("df"), F.max("idf").alias("idf")), own.join(norms, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def lexical_scores(queries: DataFrame, postings: DataFrame, q: str = "item_id", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """q, key, lexical: cosine of query and document over the terms that both have.

    A document's postings are brought together before they meet the queries, so that the products, of which there are very many, aren't shuffled.
    """
    a = table(queries.select(q, "term", F.col("w").alias("wq")), "lexical-queries")
    a = F.broadcast(a) if a.count() <= BROADCAST_TERMS else a
    postings = postings.repartition(parts, key) if parts else postings.repartition(key)
    return postings.join(a, "term").groupBy(q, key).agg(F.sum(F.col("wq") * F.col("w")).alias("lexical"))


def candidate_scores(candidates: DataFrame, own: DataFrame, q: str, key: str) -> DataFrame:
    """q, key, lexical of the given pairs only: the cosine of two texts of one table of weights (id, term, w).

    Both texts' terms are looked up by id, so no pair beyond the candidates is ever built.
    """
    pairs = candidates.select(q, key).distinct()
    asked = pairs.join(own.select(F.col("id").alias(q), "term", F.col("w").alias("wq")), q)
    return asked.join(own.select(F.col("id").alias(key), "term", "w"), [key, "term"]).groupBy(q, key).agg(F.sum(F.col("wq") * F.col("w")).alias("lexical"))


def _candidates(asked: DataFrame, postings: DataFrame, least: DataFrame, q: str, key: str) -> DataFrame:
    """q, key of all documents that can score ``least`` (q, least) or more.

    A query's terms are left out, the most frequent first, as long as what they could add together stays below its least score: by the greatest weight of each in any
    document, or by Cauchy and Schwarz, as documents have length one. A document without any of the other terms can't get there.
    """
    order = W.partitionBy(q).orderBy(F.desc("df"), "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    most = F.least(F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(order)), F.sum(F.col("wq") * F.col("top")).over(order))
    needed = asked.withColumn("most", most).join(least, q).filter(F.col("most") >= F.col("least") - 1e-6)
    return needed.select(q, "term").join(postings.select(key, "term"), "term").select(q, key).distinct()


def lexical_top(queries: DataFrame, postings: DataFrame, n: int, q: str = "item_id", key: str = "doc_id", min_score: float = 0.0, kinds: DataFrame | None = None, first: float = 0.5) -> DataFrame:
    """q, key, lexical (and kind) of the n best documents of each query with at least ``min_score``, for each kind if kinds (key, kind) are given; ties by key.

    Documents that can score ``first`` are scored at once. The n-th best of them is a score that others must reach, and those that can are scored
    then; a query (or kind) that has fewer than n goes by ``min_score``. So frequent terms give candidates only to queries that need them, and no other pair
    is built. Scores are rounded to 6 digits, as ties are.
    """
    postings = table(postings.select(key, "term", "w"), "lexical-postings")
    queries = table(queries.select(q, "term", F.col("w").alias("wq")), "lexical-queries")
    impact = postings.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("top"))
    asked = table(queries.join(impact, "term"), "lexical-asked")

    def scored(least: DataFrame) -> DataFrame:
        pairs = _candidates(asked, postings, least, q, key)
        exact = pairs.join(queries, q).join(postings, [key, "term"]).groupBy(q, key).agg(F.round(F.sum(F.col("wq") * F.col("w")), 6).alias("lexical"))
        return exact.join(kinds, key) if kinds is not None else exact.withColumn("kind", F.lit(None).cast("string"))

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy(q, "kind").orderBy(F.desc("lexical"), key))).filter(F.col("rank") <= n)

    ids = asked.select(q).distinct()
    begun = table(scored(ids.withColumn("least", F.lit(max(first, min_score)))), "lexical-begun")
    full = best(begun).groupBy(q, "kind").agg(F.count(F.lit(1)).alias("n"), F.min("lexical").alias("nth")).filter(F.col("n") == n)
    # every kind must have its n before a query's bound rises
    wanted = kinds.select("kind").distinct().count() if kinds is not None else 1
    bound = full.groupBy(q).agg(F.count(F.lit(1)).alias("kinds"), F.min("nth").alias("nth")).filter(F.col("kinds") == wanted)
    least = ids.join(bound.select(q, "nth"), q, "left").select(q, F.greatest(F.coalesce("nth", F.lit(0.0)), F.lit(float(min_score))).alias("least"))
    out = best(scored(table(least, "lexical-least")).filter(F.col("lexical") >= min_score))
    return out if kinds is not None else out.drop("kind")


#: Cells of documents and queries that a task scores at a time.
CELLS = 2_000_000


def _best_cells(n: int, queries: int, cells: int):
    """mapInArrow function over postings in the order of their keys, with the numbers and weights of the queries that ask for the term: the n best keys of each query and kind of every few documents."""

    def scored(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key, kind, w, asks = (t.column(c).chunk(0) for c in ("key", "kind", "w", "asks"))
        of_key = key.dictionary_encode()
        row = of_key.indices.to_numpy()
        kinds = kind.dictionary_encode(null_encoding="encode")
        own = np.zeros(len(of_key.dictionary), np.int64)
        own[row] = kinds.indices.to_numpy()
        each, asks = pc.list_value_length(asks).to_numpy(), asks.flatten()
        at = np.repeat(row.astype(np.int64) * queries, each) + asks.field("number").to_numpy()
        size = len(own) * queries
        score = np.bincount(at, np.repeat(w.to_numpy(), each) * asks.field("wq").to_numpy(), size).reshape(-1, queries)
        met = (np.bincount(at, minlength=size) > 0).reshape(-1, queries)
        rows, asked = [], []
        for k in range(len(kinds.dictionary)):
            mine = np.flatnonzero(own == k)
            # rows are in the order of the keys, and so are ties
            first = np.argsort(np.where(met[mine], -np.round(score[mine], 6), np.inf), axis=0, kind="stable")[:n]
            q = np.broadcast_to(np.arange(queries), first.shape)[met[mine[first], np.arange(queries)]]
            rows.append(mine[first[met[mine[first], np.arange(queries)]]])
            asked.append(q)
        rows, asked = np.concatenate(rows), np.concatenate(asked)
        return pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), of_key.dictionary.take(pa.array(rows)), kinds.dictionary.take(pa.array(own[rows])), pa.array(score[rows, asked])], ["number", "key", "kind", "lexical"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, left = max(1, cells // queries), None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            row = pa.concat_arrays(t.column("key").chunks).dictionary_encode().indices.to_numpy() if t.num_rows else np.zeros(0, np.int32)
            # the last document may go on in the next batch
            begin, done = 0, int(row[-1]) if len(row) else 0
            for i in range(0, done, most):
                end = int(np.searchsorted(row, min(i + most, done)))
                yield scored(t.slice(begin, end - begin))
                begin = end
            left = t.slice(begin)
        if left is not None and left.num_rows:
            yield scored(left)

    return run


def lexical_best(queries: DataFrame, postings: DataFrame, n: int, kinds: DataFrame, q: str = "item_id", key: str = "doc_id", cells: int = CELLS) -> DataFrame:
    """q, key, kind, lexical (to 6 digits), rank of the n best documents of each query and kind, as of ``lexical_top`` without a least score.

    Kinds in which few documents come near a query leave no bound to cut candidates by. So all pairs are scored, but where a document's postings lie: a term carries
    the queries that ask for it, a task sums up products in an array of some documents and all queries, and hands on its best only. Where
    queries are too many to be broadcast, candidates are.
    """
    own = table(queries.select(q, "term", F.col("w").alias("wq")), "lexical-queries")
    if own.count() > BROADCAST_TERMS:
        return lexical_top(own.withColumnRenamed("wq", "w"), postings, n, q=q, key=key, kinds=kinds)
    numbers = table(own.select(q).distinct().withColumn("number", F.row_number().over(W.orderBy(q)) - 1), "lexical-numbers")
    asks = own.join(F.broadcast(numbers), q).groupBy("term").agg(F.collect_list(F.struct("number", "wq")).alias("asks"))
    types = postings.schema[key].dataType.simpleString(), kinds.schema["kind"].dataType.simpleString()
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = postings.join(kinds, key).repartition(parts, key).join(F.broadcast(asks), "term").select(F.col(key).alias("key"), "kind", "w", "asks").sortWithinPartitions("key")
    best = met.mapInArrow(_best_cells(n, max(1, numbers.count()), cells), f"number long, key {types[0]}, kind {types[1]}, lexical double")
    best = best.join(F.broadcast(numbers.select(q, F.col("number").cast("long").alias("number"))), "number").select(q, F.col("key").alias(key), "kind", F.round("lexical", 6).alias("lexical"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy(q, "kind").orderBy(F.desc("lexical"), key))).filter(F.col("rank") <= n)


def search(scored: DataFrame, q: str, key: str, score: str = "lexical", min_score: float = 0.3, n: int = 5) -> DataFrame:
    """The n best of each query with at least ``min_score``, with rank and relevance; ties by key."""
    own = scored.filter(F.col(score) >= min_score).withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy(F.desc(score), key)))
    return own.filter(F.col("rank") <= n).withColumn("relevance", relevance(F.col(score)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


#: Rows of a block of vectors, and bytes of all query blocks up to which they are broadcast.
BLOCK, BROADCAST = 2_000, 32 << 20
_DIGITS = 12


def _blocks(vectors: DataFrame, key: str, column: str, by: str, size: int = BLOCK) -> DataFrame:
    """by, keys, dims, matrix: vectors of length one (or none) as blocks of at most ``size`` rows of one value of ``by``, from neighbours of a partition. Null vectors fall away."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = b.column("by").to_numpy()
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order])) + 1
            for run_of in np.split(order, cut):
                for i in range(0, len(run_of), size):
                    own = pa.array(run_of[i : i + size])
                    lists = b.column("v").take(own)
                    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                    norm = np.sqrt((m * m).sum(1, keepdims=True))
                    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                    keys = b.column("key").take(own)
                    yield pa.RecordBatch.from_arrays([pa.array([group[own[0].as_py()]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), keys), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["by", "keys", "dims", "matrix"])

    own = vectors.filter(F.col(column).isNotNull()).select(F.col(by).cast("long").alias("by"), F.col(key).alias("key"), F.col(column).alias("v"))
    return own.mapInArrow(run, f"by long, keys array<{kind}>, dims int, matrix binary")


def _products(k: int, hold: int = 500_000):
    """mapInArrow function over pairs of blocks: each query's k nearest of what a task has seen, by distance (rounded) and key."""

    def least(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).sort_by([("q", "ascending"), ("distance", "ascending"), ("key", "ascending")])
        if not t.num_rows:
            return t
        q = t.column("q").combine_chunks()
        code = q.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        return t.filter(pa.array(place < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for keys, m, qs, qm, dims in zip(*(b.column(c) for c in ("keys", "matrix", "q_keys", "q_matrix", "dims")), strict=True):
                d = np.frombuffer(m.as_py()).reshape(-1, dims.as_py())
                distance = np.round(1 - np.frombuffer(qm.as_py()).reshape(-1, dims.as_py()) @ d.T, _DIGITS)
                if d.shape[0] > k:
                    at, of = np.nonzero(distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k])
                else:
                    at, of = np.nonzero(np.ones(distance.shape, bool))
                parts.append(pa.table({"q": qs.values.take(pa.array(at)), "key": keys.values.take(pa.array(of)), "distance": distance[at, of]}))
                held += len(at)
                if held > hold:
                    parts = [least(parts)]
                    held = parts[0].num_rows
        if parts:
            yield from least(parts).combine_chunks().to_batches()

    return run


def _nearest_of(blocks: DataFrame, asked: DataFrame, k: int, kinds: tuple[str, str]) -> DataFrame:
    """q, key, distance: the k nearest keys of every query among the blocks that share a value of ``by`` with one of its blocks."""
    asked = table(asked.select("by", F.col("keys").alias("q_keys"), F.col("matrix").alias("q_matrix")), "query-blocks")
    size = asked.agg(F.sum(F.octet_length("q_matrix"))).first()[0] or 0
    pairs = blocks.join(F.broadcast(asked) if size <= BROADCAST else asked, "by")
    found = pairs.select("keys", "dims", "matrix", "q_keys", "q_matrix").mapInArrow(_products(k), f"q {kinds[0]}, key {kinds[1]}, distance double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "key"))).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, docs: DataFrame, k: int, q: str = "query_id", key: str = "vec_id", column: str = "embedding", keep: Column | None = None, block: int = BLOCK) -> DataFrame:
    """q, key, distance (cosine, to 12 digits), rank of the k nearest documents of each query, ties by key; a filter on documents holds before the cut.

    Exact: blocks of documents meet blocks of queries as products of matrices, and a task keeps each query's best k of all it has seen before anything is
    shuffled. Query blocks are broadcast up to ``BROADCAST`` bytes; more are joined by block. Rows without a vector are passed over.
    """
    if keep is not None:
        docs = docs.filter(keep)
    kinds = (queries.schema[q].dataType.simpleString(), docs.schema[key].dataType.simpleString())
    parts = max(1, -(-queries.count() // block))
    asked = _blocks(queries.withColumn("part", F.pmod(F.xxhash64(q), F.lit(parts))).repartition(min(parts, 200), "part").sortWithinPartitions("part"), q, column, "part", block)
    own = _blocks(docs.withColumn("part", F.lit(0)), key, column, "part", block)
    own = own.drop("by").withColumn("by", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return _nearest_of(own, asked, k, kinds).select(F.col("q").alias(q), F.col("key").alias(key), "distance", "rank")


def centres(vectors: DataFrame, n: int, key: str = "vec_id", column: str = "embedding", sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """n directions by spherical k-means over at most ``sample`` of the vectors, chosen by hash: what the index is fitted on."""
    some = vectors.filter(F.col(column).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(column).alias("v")).orderBy("h").limit(sample).toPandas()
    m = np.stack([np.asarray(v, float) for v in some["v"]]) if len(some) else np.zeros((1, 1))
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    c = m[np.linspace(0, len(m) - 1, min(n, len(m))).astype(int)]
    for _ in range(rounds):
        own = (m @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def _closest(column: str, c: np.ndarray, n: int) -> Column:
    """The numbers of a vector's n closest centres."""

    @F.pandas_udf(ArrayType(LongType()))
    def closest(v: pd.Series) -> pd.Series:
        m = np.stack([np.zeros(c.shape[1]) if x is None else np.asarray(x, float) for x in v])
        return pd.Series(list(np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :n]))

    return closest(F.col(column))


def indexed(vectors: DataFrame, c: np.ndarray, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, vector and the number of its closest centre, for every row: an inverted file, dealt and ordered by centre so that a very full one is spread."""
    own = vectors.filter(F.col(column).isNotNull()).select(key, column, F.element_at(_closest(column, c, 1), 1).alias("centre"))
    return table(own.repartitionByRange("centre", key).sortWithinPartitions("centre"), "vector-index")


def nearest_indexed(queries: DataFrame, index: DataFrame, c: np.ndarray, k: int, probes: int, q: str = "query_id", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """q, key, distance, rank as of ``nearest`` among the rows of each query's ``probes`` closest centres, whose distances are exact.

    Recall grows with probes, and is whole where they are all the centres.
    """
    kinds = (queries.schema[q].dataType.simpleString(), index.schema[key].dataType.simpleString())
    asked = queries.filter(F.col(column).isNotNull()).select(q, column, F.explode(_closest(column, c, probes)).alias("centre"))
    asked = _blocks(asked.repartitionByRange("centre", q).sortWithinPartitions("centre"), q, column, "centre")
    return _nearest_of(_blocks(index, key, column, "centre"), asked, k, kinds).select(F.col("q").alias(q), F.col("key").alias(key), "distance", "rank")


def importance(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, importance: words times one plus the share of distinct ones, over the greatest of all."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    counts = docs.select(key, words.alias("words")).select(key, F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("u"))
    raw = table(counts.select(key, F.when(F.col("n") > 0, F.col("n") * (1 + F.col("u") / F.col("n"))).otherwise(F.lit(0.0)).alias("raw")), "importance-counts")
    top = raw.agg(F.max("raw").alias("top"))
    return raw.join(F.broadcast(top)).select(key, F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.lit(0.0)).alias("importance"))


def hybrid(candidates: DataFrame, lexical: DataFrame, weight: DataFrame, q: str, key: str, alpha: float = 0.7, beta: float = 0.2, gamma: float = 0.1) -> DataFrame:
    """Ranking by alpha times semantic score (1 - min(d/2, 1)), beta times lexical and gamma times importance; ties (to 12 digits, as sums have no order) by key."""
    semantic = 1 - F.least(F.col("distance") / 2, F.lit(1.0))
    out = candidates.join(lexical, [q, key], "left").join(weight, key, "left").withColumn("score", alpha * semantic + beta * F.coalesce("lexical", F.lit(0.0)) + gamma * F.coalesce("importance", F.lit(0.0)))
    return out.select(q, key, "score", F.row_number().over(W.partitionBy(q).orderBy(F.desc(F.round("score", 12)), key)).alias("rank"))


def _greedy(key: str, k: int, limit: float | None, balance: float | None):
    """Selection of one query's candidates (some tens of rows): near copies out, or best of relevance against likeness."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank"]).reset_index(drop=True)
        v = np.stack([np.asarray(x, float) for x in pdf["embedding"]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        like, taken = v @ v.T, []
        if limit is not None:
            for i in range(len(pdf)):
                if all(like[i, j] <= limit for j in taken):
                    taken.append(i)
        else:
            s = pdf["score"].to_numpy(float)
            s = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
            left = list(range(len(pdf)))
            while left and len(taken) < k:
                best = max(left, key=lambda i: (balance * s[i] - (1 - balance) * (max(like[i, j] for j in taken) if taken else 0.0), -i))
                taken.append(best)
                left.remove(best)
        out = pdf.iloc[taken].copy()
        out["position"] = range(1, len(out) + 1)
        return out[[pdf.columns[0], key, "position"]]

    return run


def suppress(ranked: DataFrame, vectors: DataFrame, q: str, key: str, limit: float = 0.95) -> DataFrame:
    """Candidates in order of rank without those closer than ``limit`` (cosine) to one before; position counts what stays."""
    own = ranked.join(vectors.select(key, "embedding"), key).select(q, key, "rank", "embedding")
    kinds = dict(ranked.dtypes)
    return own.groupBy(q).applyInPandas(_greedy(key, 0, limit, None), f"{q} {kinds[q]}, {key} {kinds[key]}, position int")


def mmr(ranked: DataFrame, vectors: DataFrame, q: str, key: str, k: int = 5, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: k of each query's candidates, by scaled score against likeness to what is chosen."""
    own = ranked.join(vectors.select(key, "embedding"), key).select(q, key, "rank", "score", "embedding")
    kinds = dict(ranked.dtypes)
    return own.groupBy(q).applyInPandas(_greedy(key, k, None, balance), f"{q} {kinds[q]}, {key} {kinds[key]}, position int")


def latest(rows: DataFrame, key: str, order: str, deleted: DataFrame | None = None) -> DataFrame:
    """Upserts: the last row per key, without deleted keys."""
    out = rows.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("k = 1").drop("k")
    return out.join(deleted.select(key).distinct(), key, "left_anti") if deleted is not None else out


def unindexed(docs: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose content hash isn't in the index yet."""
    return docs.withColumn("content_id", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).join(index.select("content_id").distinct(), "content_id", "left_anti")


def relevance(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")
