"""Sharding by consistent hashing with bounded loads.

Every shard has many virtual nodes on a ring; a document belongs to the next virtual node clockwise of its own
position. A shard takes at most its bound (``ceil(n / shards)`` or ``floor(n / shards)`` rows, which add up to n), its own
documents first; what overflows continues clockwise to the next virtual node of a shard with room. So counts
differ by one at most, and only overflow leaves its home shard.

The ring has a fixed number of positions, so the walk works on one count a position (a bounded table), and rows
find their shard by their rank among the rows of their position. A position of very many rows (one doc_id, or none, over and over) is
ranked in cuts of bounded size, each from where the cuts before it end.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.llm.common import table

#: Ring positions, a power of two: one count each comes to the driver, whatever the size of the input.
POSITION_BITS = 16
VIRTUAL_NODES = 128
#: Rows that are ranked in one group.
RANKED = 100_000


def virtual_nodes(shards: int, each: int = VIRTUAL_NODES, bits: int = POSITION_BITS) -> list[tuple[int, int]]:
    """(position, shard) in ring order; a shard's nodes don't depend on how many shards there are."""
    nodes = [
        (int.from_bytes(sha256(f"{s}:{v}".encode()).digest()[:8], "big") >> (64 - bits), s)
        for s in range(shards)
        for v in range(each)
    ]
    return sorted(nodes)


def walk(counts: dict[int, int], shards: int, each: int = VIRTUAL_NODES, bits: int = POSITION_BITS) -> list[tuple[int, int, int, int]]:
    """(position, shard, first rank, rows) for counts of rows by position; ranks are those within a position."""
    nodes = virtual_nodes(shards, each, bits)
    at = [p for p, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    placed: list[tuple[int, int, int, int]] = []
    over: list[tuple[int, int, int, int]] = []
    for position in sorted(counts):
        home = bisect_left(at, position) % len(nodes)
        shard, rows = nodes[home][1], counts[position]
        take = min(rows, room[shard])
        if take:
            placed.append((position, shard, 0, take))
            room[shard] -= take
        if take < rows:
            over.append((position, home, take, rows - take))
    for position, home, first, rows in over:
        node = home
        while rows:
            node = (node + 1) % len(nodes)
            shard = nodes[node][1]
            if take := min(rows, room[shard]):
                placed.append((position, shard, first, take))
                room[shard] -= take
                first, rows = first + take, rows - take
    return placed


def assign(docs: DataFrame, shards: int = 24, each: int = VIRTUAL_NODES, bits: int = POSITION_BITS, ranked: int = RANKED) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 8, a null text counting as empty; law is ``rows``. Slots run from 0
    without gaps in each shard. Null and repeated doc_ids share a position and are told apart by crc and size, ties
    by any order. Other columns aren't read. An empty table gives no rows. grown_shard is null: it belongs to the
    law that knows no bound.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    mixed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        mixed.alias("mixed"),
        F.shiftrightunsigned(mixed, 64 - bits).cast("int").alias("position"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = table(rows, "ring-rows")
    counts = {r.position: r["count"] for r in rows.groupBy("position").count().collect()}
    # a rank's shard, and where its run of ranks begins among the shard's slots
    runs, filled = [], [0] * shards
    for position, shard, first, n in walk(counts, shards, each, bits):
        runs.append((position, shard, first, first + n, filled[shard]))
        filled[shard] += n
    runs = spark.createDataFrame(runs, "position int, shard int, first long, last long, base long")
    # cuts of large positions; rows that are the same in all go to 64 of them
    large = [(p, -(-n // ranked)) for p, n in counts.items() if n > ranked]
    cut = F.lit(0).cast("long")
    if large:
        rows = rows.join(F.broadcast(spark.createDataFrame(large, "position int, cuts long")), "position", "left")
        cut = F.pmod(F.xxhash64("mixed", "text_crc32", "size", F.pmod("row", F.lit(64))), F.coalesce("cuts", F.lit(1)))
    rows = rows.withColumn("cut", cut)
    order = W.partitionBy("position", "cut").orderBy("mixed", "doc_id", "text_crc32", "size", "row")
    numbered = rows.withColumn("rank", F.row_number().over(order) - F.lit(1))
    if large:
        sizes = rows.filter(F.col("cuts").isNotNull()).groupBy("position", "cut").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("position", "cut", (F.sum("n").over(W.partitionBy("position").orderBy("cut")) - F.col("n")).alias("before"))
        numbered = numbered.join(before, ["position", "cut"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    placed = numbered.join(F.broadcast(runs), "position").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
