"""Exact dedup as a stateful stream: disk-backed keyed state without expiry.

A stream of (digest, identifier, locator) rows goes through a streaming aggregation keyed by the digest of the
normalised text. Its RocksDB state keeps, for ever, each digest with its count, the identifier that stays and the
locator of that identifier's content. A later run over more files goes on from the same state when it is given the
same checkpoint folder. Digests that were hit more than once are checked on full bytes before any row is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.llm.common import ascii_lower, drop, scratch, table

#: The state store lies on disk; it sets no space aside in advance, which each of many small stores would.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: What the stream carries of a row; the text itself never enters state. uid tells rows apart that are the same.
ENTRY = "digest binary, doc_id long, uid long, file string, block long"
#: Digests or dropped rows up to this many are broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 250_000
BEST = "struct<doc_id:long,uid:long,file:string,block:long>"


def with_digest(docs: DataFrame, norm: str = "norm", digest: str = "digest") -> DataFrame:
    """Adds ``norm`` (the text with A-Z lower-cased, null as empty) and its SHA-256."""
    docs = docs.withColumn(norm, ascii_lower(F.coalesce(F.col("text"), F.lit(""))))
    return docs.withColumn(digest, F.unhex(F.sha2(norm, 256)))


def entries(docs: DataFrame) -> DataFrame:
    """The narrow rows that the stream reads: digest, identifier and content locator (file and block of it)."""
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.monotonically_increasing_id().alias("uid"),
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("block"),
    )
    return with_digest(placed).select("digest", "doc_id", "uid", "file", "block")


def keep_state(spark: SparkSession, source: str, checkpoint: str, sink: str, files_a_batch: int = 1000) -> DataFrame:
    """Runs what is new in ``source`` through the keyed state; the state's latest row per digest, by way of ``sink``."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        best = F.max(F.struct("doc_id", "uid", "file", "block")).alias("best")
        state = stream.groupBy("digest").agg(best, F.count(F.lit(1)).alias("seen"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(f"digest binary, best {BEST}, seen long, epoch int").parquet(sink)
    return changes.groupBy("digest").agg(F.max_by("best", "epoch").alias("best"), F.max("seen").alias("seen"))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): each row's digest, sub and uid; each group's digest, sub, best row and size.

    sub is 0 but where unlike texts were found to share a digest: then it tells the texts apart.
    """
    spark = docs.sparkSession
    narrow = table(entries(docs), "dedup-entries")
    checkpoint, sink = scratch(spark, "dedup-state"), scratch(spark, "dedup-changes")
    spark.createDataFrame([], f"digest binary, best {BEST}, seen long").write.parquet(f"{sink}/epoch=-1")
    state = table(keep_state(spark, narrow.scratch_path, checkpoint, sink), "dedup-groups")
    drop(spark, checkpoint, sink)
    hits = state.filter("seen > 1").select("digest")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    # full bytes of everything that hit, summed up where it lies before it moves
    texts = with_digest(docs.select("doc_id", "text")).join(hits, "digest", "left_semi")
    texts = texts.select("digest", "norm").distinct()
    unlike = texts.select("digest").groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    unlike = table(unlike, "dedup-unlike")
    rows = narrow.withColumn("sub", F.lit(0).cast("long"))
    found = state.select("digest", F.lit(0).cast("long").alias("sub"), "best", "seen")
    if not unlike.isEmpty():  # regroup those digests by the text itself
        own = with_digest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid")))
        own = own.join(unlike, "digest", "left_semi").withColumn("sub", F.xxhash64("norm"))
        own = table(own.select("digest", "doc_id", "uid", F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), "sub"), "dedup-own")
        rows = rows.join(unlike, "digest", "left_anti").unionByName(own)
        split = own.groupBy("digest", "sub").agg(F.max(F.struct("doc_id", "uid", "file", "block")).alias("best"), F.count(F.lit(1)).alias("seen"))
        found = found.join(unlike, "digest", "left_anti").unionByName(split)
    return rows, found


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, keep_file, keep_block.

    Texts are equal when identical after lower-casing A-Z; null is the empty text, and empty texts are equal to one
    another. The row with the largest doc_id of a group stays; where rows repeat that doc_id, one of them stays. A null
    doc_id is smaller than any. Other columns aren't read. An empty table gives no rows. keep_file and keep_block
    locate the content that stays.
    """
    rows, found = groups(docs)
    return rows.join(found, ["digest", "sub"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("seen").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("best.file").alias("keep_file"),
        F.col("best.block").alias("keep_block"),
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that ``dedup`` keeps, with all their columns, which may have any names but the two marks used here.

    Null and empty texts are one group, of which one row stays. Of rows that repeat doc_id and text one stays. An empty table gives no rows.
    """
    own, mark = "__dedup_digest", "__dedup_norm"
    decided = table(dedup(docs).select("doc_id", F.unhex("text_sha256").alias(own), "kept"), "dedup-decided")
    pairs = decided.groupBy("doc_id", own).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    pairs = table(pairs.filter("not kept or n > 1"), "dedup-odd")
    rows = with_digest(docs, mark, own).drop(mark)

    def match(few: DataFrame):
        return rows["doc_id"].eqNullSafe(few["doc_id"]) & (rows[own] == few[own])

    odd = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
    kept = rows.join(odd, match(odd), "left_anti")  # what is neither dropped nor there several times
    several = pairs.filter("kept")
    if not several.isEmpty():
        kept = kept.unionByName(rows.join(several, match(several), "left_semi").dropDuplicates([own, "doc_id"]))
    return kept.select(*docs.columns)
