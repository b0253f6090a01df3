"""Line dedup: content-defined chunks of lines, and windows of lines for what chunks can't hold.

A line is known by its hash. A rolling hash over every two adjacent line hashes is lowest, among its neighbours, at content-defined places: there a
chunk begins. So a boundary depends on the four lines around it alone, chunks have two lines and more, and an insertion shifts no boundary but
those beside it. Chunks that come more than once, over all documents, go but for the first one.

A passage of a few lines needn't hold a whole chunk, and the lines at a longer one's ends share their chunks with whatever stands beside them. So
the rolling windows themselves, and lines of many words, are looked up in the same way. The key of a chunk, window or line is the array of
its line hashes; the lines behind a repeated key are compared byte by byte before any of them goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import WORD, table

#: A line of so many words is looked up by itself.
LONG_LINE = 50


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_chunk_starts(df: DataFrame) -> DataFrame:
    """Adds to ``lines`` their hashes and starts: the first lines (from 0) of a text's chunks, which are 0 and where the rolling hash over two lines is
    lower than both its neighbours. Each array is a column of its own, so that no lambda works it out anew."""
    n = F.size("hashes")
    df = df.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    df = df.withColumn("rolling", F.zip_with(F.slice("hashes", 1, n - 1), F.slice("hashes", 2, n - 1), lambda a, b: F.xxhash64(a, b)))
    low = F.filter(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: (F.get("rolling", i) < F.get("rolling", i - 1)) & (F.get("rolling", i) < F.get("rolling", i + 1)))
    return df.withColumn("starts", F.concat(F.array(F.lit(0)), F.when(n > 3, low).otherwise(F.array().cast("array<int>")))).drop("rolling")


def pieces(docs: DataFrame, words: int = LONG_LINE) -> DataFrame:
    """doc_id, mark, first (line from 0), key of the texts' chunks, rolling windows and long lines; a chunk of two lines is a window."""
    df = with_chunk_starts(docs.select("doc_id", _mark(), lines_of(F.col("text")).alias("lines")))
    n = F.size("lines")
    spans = F.zip_with("starts", F.concat(F.slice("starts", 2, n), F.array(n)), lambda a, z: F.struct(a.alias("first"), F.slice("hashes", a + 1, z - a).alias("key")))
    chunks = F.filter(spans, lambda s: F.size(s["key"]) > 2)
    pairs = F.zip_with(F.slice("hashes", 1, n - 1), F.slice("hashes", 2, n - 1), lambda a, b: F.array(a, b))
    windows = F.transform(pairs, lambda k, i: F.struct(i.alias("first"), k.alias("key")))
    # words have a byte each and one between
    wordy = F.transform("lines", lambda x: (F.length(x) >= 2 * words - 1) & (F.regexp_count(x, F.lit(WORD)) >= words))
    long = F.zip_with(wordy, F.transform("hashes", lambda h, i: F.struct(i.alias("first"), F.array(h).alias("key"))), lambda w, p: F.when(w, p))
    return df.select("doc_id", "mark", F.inline(F.concat(chunks, windows, F.array_compact(long))))


def _mark() -> Column:
    """Tells texts under one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def repeated(docs: DataFrame, words: int = LONG_LINE) -> DataFrame:
    """doc_id, mark, line, hash, goes of the lines under every repeated key; a line goes if it lies under a key of which neither this place nor one
    that shares a line with it in the same text is the first."""
    places = pieces(docs, words)
    twice = places.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "first")).alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = table(twice.select("key", "stays"), "lines-twice")
    same = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("mark") == F.col("stays.mark"))
    goes = ~(same & (F.col("first") < F.col("stays.first") + F.size("key")))
    found = places.join(twice, "key").select("doc_id", "mark", "first", goes.alias("goes"), F.posexplode("key").alias("k", "hash"))
    return found.groupBy("doc_id", "mark", (F.col("first") + F.col("k")).alias("line")).agg(F.min("hash").alias("hash"), F.max("goes").alias("goes"))


def _runs(at: Column) -> Column:
    """Array of (first, lines) of the runs of sorted line numbers."""
    n = F.size(at)
    before = F.concat(F.array(F.lit(-2)), F.slice(at, 1, n - 1))
    after = F.concat(F.slice(at, 2, n - 1), F.array(F.lit(-2)))
    first = F.filter(F.zip_with(at, before, lambda x, b: F.when(x != b + 1, x)), lambda x: x.isNotNull())
    last = F.filter(F.zip_with(at, after, lambda x, a: F.when(a != x + 1, x)), lambda x: x.isNotNull())
    return F.zip_with(first, last, lambda a, z: F.struct(a.alias("first"), (z - a + 1).alias("lines")))


def _with_lines(own: DataFrame, at: DataFrame) -> DataFrame:
    """Rows of own with the sorted line numbers that ``at`` has for them, null for none."""
    per = at.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line")).alias("at"))
    match = own["doc_id"].eqNullSafe(per["doc_id"]) & (own["mark"] == per["mark"])
    return own.join(per, match, "left").select(own["doc_id"], own["text"], "at")


def dedup(docs: DataFrame, words: int = LONG_LINE) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, removed_chunks, removed_lines, text (what is left of it).

    Lines end at a line feed. Of equal chunks, of equal windows of two adjacent lines and of equal lines of ``words`` words or more the one with the
    smallest (doc_id, hash of the text, line) stays; the lines of the others go, but for those that overlap it. So every line that goes stays in
    another place. A line whose hash stands for unlike lines stays. removed_chunks counts the runs of removed lines. Rows that repeat doc_id and
    text count as one document and are treated alike. A null text is one empty line and stays null. Other columns aren't read. An empty table
    gives no rows.
    """
    lines = lines_of(F.col("text"))
    own = docs.select("doc_id", "text", _mark())
    found = table(repeated(docs, words), "lines-found")
    # bytes: a hash stands for one line only if all the lines under it are the same
    seen = _with_lines(own, found).select("at", lines.alias("lines")).select(F.explode(F.transform("at", lambda i: F.get("lines", i))).alias("line"))
    seen = seen.groupBy(F.xxhash64("line").alias("hash")).agg(F.min("line").alias("low"), F.max("line").alias("high"))
    # dealt once more: the few hashes that are left are then a stage whose size is known, and a very common line can be split
    unlike = seen.filter("low <> high").select("hash").repartition(8)
    gone = _with_lines(own, found.filter("goes").join(unlike, "hash", "left_anti").select("doc_id", "mark", "line"))
    gone = gone.select("doc_id", "text", lines.alias("lines"), F.size(F.coalesce("at", F.array())).alias("removed_lines"), F.when(F.col("at").isNotNull(), _runs(F.col("at"))).alias("gone"))
    # what stays lies between the removed runs
    ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["first"] + g["lines"]))
    starts = F.concat(F.transform("gone", lambda g: g["first"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, z: F.slice("lines", a + 1, z - a)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n", ""))
    return gone.select("doc_id", F.size("lines").alias("n_lines"), F.size(F.coalesce("gone", F.array())).alias("removed_chunks"), "removed_lines", text.alias("text"))
