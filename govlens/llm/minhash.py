"""MinHash near-dedup: circulant signatures, banding, and exact Jaccard on whole shingle sets.

Signatures use two permutations of the 32-bit ring: the first one scatters a shingle, the second one, shifted on by a
fixed step for each coordinate, gives all coordinates. Documents with equal sets become one node before anything is
compared. Nodes that share a band meet in groups of bounded size, so that no task holds a bucket. A group first compares signatures and names
the nodes with a likely partner; only their sets are brought, and only links that join what isn't joined yet come out.

A bucket beyond ``BLOCK`` nodes goes in two rounds. First each node meets, in a block of the first and of the last such bucket that it has, that bucket's
representative and the block's other nodes; of many near copies nearly all that link are then in one component. What is left is exact: of the nodes that share enough
shingles with others of large buckets, every one outside a bucket's largest component meets all the bucket's nodes of other components and of a size that can link. So the work grows with the
number of nodes times those that are left, not with the square of the bucket, and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm import text as T
from govlens.llm.common import gone, small_batches, table
from govlens.llm.components import components

#: Bands of a signature at 85 %; ``bands`` gives those of another bound.
BANDS, ROWS = 20, 4
#: Share of pairs at the bound that may share no band.
MISS = 4e-7
BLOCK = 256
#: Share of equal coordinates below which a pair isn't looked at: a pair at 0.85 falls below it once in 70 million, so that bands alone set the recall.
LIKELY = 0.6
#: Ids up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
# parts that the rows of one component are dealt to where they meet a value of it
SALTS = 256

_STEP = np.uint64(0x9E3779B1)


def bands(percent: int) -> int:
    """Bands so that a pair at the bound shares none with probability MISS at most."""
    share = percent / 100
    if share >= 1:
        return BANDS
    return max(BANDS, math.ceil(math.log(MISS) / math.log1p(-(share**ROWS))))


def floor(percent: int) -> float:
    """Share of equal coordinates below which a pair isn't looked at: at most LIKELY, and a pair at the bound falls below it a tenth as often as it may miss the bands."""
    n, share, below, k = bands(percent) * ROWS, percent / 100, 0.0, 0
    while k < n:
        below += math.comb(n, k) * share**k * (1 - share) ** (n - k)
        if below > MISS / 10:
            break
        k += 1
    return min(LIKELY, k / n)


def _scatter(x: np.ndarray) -> np.ndarray:
    """First permutation's place of each 64-bit shingle hash on the 32-bit ring."""
    return (x >> np.uint64(32)).astype(np.uint32)


def _permute(x: np.ndarray) -> np.ndarray:
    """Second permutation of the 32-bit ring, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k steps, over the set."""
    places = _scatter(shingles)[None, :]
    shifts = (np.arange(size, dtype=np.uint64) * _STEP).astype(np.uint32)[:, None]
    least = np.full(size, 2**32 - 1, np.uint32)
    for i in range(0, places.shape[1], 512):
        np.minimum(least, _permute(places[:, i : i + 512] - shifts).min(1), out=least)
    return least


def node_of(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    with np.errstate(over="ignore"):
        return np.array([shingles.sum(dtype=np.uint64), T.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes()


def _sketch(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = T.shingle_sets(*T.buffers(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([node_of(x) if len(x) else None for x in sets], pa.binary()),
                    pa.array([signature(x, size).tobytes() if len(x) else None for x in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "node", "sig"],
            )

    return sketch


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [x for x in T.shingle_sets(*T.buffers(b.column("text"))) if len(x)]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [x for x in T.shingle_sets(*T.buffers(b.column("text"))) if len(x)]
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        shingles = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.binary()).take(pa.array(of, pa.int64())), pa.array(shingles)], ["node", "shingle"])


def _grouped(batches: Iterator[pa.RecordBatch], key: str = "group") -> Iterator[pa.Table]:
    """Runs of equal keys of rows that come sorted by key; a run may go on in the next batch."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not len(t):
            continue
        k = t.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        start = 0
        for stop in cuts.tolist():
            yield t.slice(start, stop - start)
            start = stop
        rest = t.slice(start)
    if rest is not None and len(rest):
        yield rest


def _flush(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)


def _first_shared(sig: np.ndarray, i: int, band: int) -> np.ndarray:
    """Which later rows share ``band``, the group's own, with row i and none before it."""
    same = (sig[i + 1 :] == sig[i]).reshape(len(sig) - i - 1, -1, ROWS).all(2)
    return ~same[:, :band].any(1)


_ROW = {"group": pa.int64(), "node": pa.binary(), "band": pa.int32(), "side": pa.int32(), "comp": pa.binary()}
GROUP = "group long, node binary, band int, side int, comp binary"


def _rules(g: pa.Table) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """(side, component number, whether only nodes of unlike sides meet, band) of a group."""
    side = g.column("side").to_numpy()
    comp = np.unique(np.array(g.column("comp").to_pylist(), dtype=object), return_inverse=True)[1]
    return side, comp, bool(side[0] >= 0), g.column("band")[0].as_py()


def _likely(batches: Iterator[pa.RecordBatch], floor: float = LIKELY, percent: int = 85) -> Iterator[pa.RecordBatch]:
    """The rows of nodes that have a likely partner here: one of another component, that the two sets' sizes and ``shared`` shingles admit, and, if
    there are sides, of the other side. Where the group belongs to a band, a pair counts in the first band that the two share."""
    out: list[tuple] = []
    for g in _grouped(batches):
        if len(g) < 2:
            continue
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(len(g), -1)
        side, comp, apart, band = _rules(g)
        n, shared = g.column("n_shingles").to_numpy(), g.column("shared").to_numpy()
        hit = np.zeros(len(g), bool)
        for i in range(len(g) - 1):
            ok = ((sig[i + 1 :] == sig[i]).mean(1) >= floor) & (comp[i + 1 :] != comp[i])
            ok &= (100 + percent) * np.minimum(shared[i + 1 :], shared[i]) >= percent * (n[i + 1 :] + n[i])
            if apart:
                ok &= side[i + 1 :] != side[i]
            if ok.any() and band >= 0:
                ok &= _first_shared(sig, i, band)
            if ok.any():
                hit[i] = True
                hit[i + 1 :] |= ok
        if hit.any():
            columns = [g.column(c).to_pylist() for c in _ROW]
            out += [tuple(c[i] for c in columns) for i in np.flatnonzero(hit)]
        if len(out) >= 5000:
            yield _flush(out, list(_ROW), list(_ROW.values()))
            out = []
    yield _flush(out, list(_ROW), list(_ROW.values()))


def _linked(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each group that join what isn't joined yet, confirmed on whole sets."""
        out: list[tuple] = []
        for g in _grouped(batches):
            sets = [np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()]
            nodes, n = g.column("node").to_pylist(), [len(x) for x in sets]
            side, comp, apart, _ = _rules(g)
            root = np.unique(comp, return_index=True)[1][comp].tolist()  # of one component: its first row

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i in range(len(sets)):
                for j in range(i + 1, len(sets)):
                    if apart and side[i] == side[j] or 100 * min(n[i], n[j]) < percent * max(n[i], n[j]) or find(i) == find(j):
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        root[find(j)] = find(i)
                        out.append((nodes[i], nodes[j]))
            if len(out) >= 5000:
                yield _flush(out, ["a", "b"], [pa.binary(), pa.binary()])
                out = []
        yield _flush(out, ["a", "b"], [pa.binary(), pa.binary()])

    return verify


def _by_group(df: DataFrame) -> DataFrame:
    return df.repartition("group").sortWithinPartitions("group", "node")


def _texts(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a table of ids, documents with them), one id for each node."""
    ids = table(nodes.select(F.col("least").alias("doc_id")).distinct(), "near-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return ids, docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")


def _shared(hot: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The nodes of large buckets, with ``shared``: how many of a node's shingles another one of them has too.

    No two of them have more in common, so a node with many shingles of its own is known to have no link here before it meets anyone.
    """
    own = table(nodes.join(hot.select("node"), "node", "left_semi").drop("shared"), "near-crowd")
    _, whole = _texts(own, docs)
    each = whole.mapInArrow(_owned, "node binary, shingle long").select("shingle", F.xxhash64("node").alias("owner"))
    single = each.groupBy("shingle").agg(F.min("owner").alias("owner"), F.max("owner").alias("last")).filter("owner = last")
    alone = single.groupBy("owner").agg(F.count(F.lit(1)).alias("alone"))
    shared = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    return table(own.withColumn("owner", F.xxhash64("node")).join(alone, "owner", "left").select("node", "least", "sig", "n_shingles", shared.alias("shared")), "near-shared")


def _links(groups: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b) table of links within groups (columns of ``GROUP``). Of a node's shingles at most ``shared`` are in any other set of its groups."""
    least_equal = floor(percent)
    likely = _by_group(groups.join(nodes.select("node", "sig", "n_shingles", "shared"), "node")).mapInArrow(lambda batches: _likely(batches, least_equal, percent), GROUP)
    likely = table(likely, "near-likely")
    # whole sets of those nodes
    ids, whole = _texts(nodes.join(likely.select("node"), "node", "left_semi"), docs)
    sets = whole.mapInArrow(_sets, "node binary, shingles binary")
    sets = sets.groupBy("node").agg(F.min("shingles").alias("shingles"))
    links = _by_group(likely.join(sets, "node")).mapInArrow(_linked(percent), "a binary, b binary")
    links = table(links.distinct(), "near-links")
    gone(likely, ids)
    return links


def _stars(hot: DataFrame, block: int) -> DataFrame:
    """Groups of large buckets: each node in a block of its first one and of its last one, with that bucket's representative.

    That is the node which lies in the most large buckets: of many near copies, one with few changes, that most others link with.
    """
    mine = hot.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", "bucket", "n"))).alias("own"))  # one a band at most
    cuts = F.ceil(F.col("n") / F.lit(block))
    reps = mine.select("node", F.size("own").alias("buckets"), F.explode("own").alias("h")).groupBy("h.bucket", "h.n").agg(F.max_by("node", F.struct("buckets", "node")).alias("node"))
    reps = reps.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)).alias("cut"), "node")
    ends = F.array_distinct(F.array(F.element_at("own", 1), F.element_at("own", -1)))
    members = mine.select("node", F.explode(ends).alias("h")).select("h.bucket", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("h.n") / F.lit(block))).alias("cut"), "node")
    both = members.unionByName(reps).dropDuplicates(["bucket", "cut", "node"])
    return both.select(F.xxhash64("bucket", "cut", F.lit("star")).alias("group"), "node", F.lit(-1).alias("band"), F.lit(-1).alias("side"), F.col("node").alias("comp"))


def _components_of(nodes: DataFrame, labels: DataFrame, name: str = "node", comp: str = "comp") -> DataFrame:
    """Adds the component of a node; a node without links is its own."""
    known = labels.select(F.col("id").alias(name), F.col("component").alias(comp))
    return nodes.join(known, name, "left").withColumn(comp, F.coalesce(comp, name))


def _onto(rows: DataFrame, node: str, values: DataFrame) -> DataFrame:
    """values, one row a component, joined to rows on component. A component may hold a third of all rows, so they are salted by node, and only
    the (component, salt) that occur get the component's row."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALTS)))
    places = salted.select("component", "salt").distinct().join(values, "component")
    return salted.join(places, ["component", "salt"]).drop("salt")


def _contracted(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links: components of components, which are few, put in place of them."""
    ends = _components_of(_components_of(more, labels, "a", "ca"), labels, "b", "cb").select("ca", "cb").filter("ca <> cb")
    above = table(components(ends, "ca", "cb").withColumnRenamed("component", "top"), "near-tops")
    fresh = above.join(labels.select(F.col("component").alias("id")).distinct(), "id", "left_anti").select("id", F.col("top").alias("component"))
    # every component gets its top, itself where nothing joins it, before the nodes do
    tops = labels.select("component").distinct().join(above.withColumnRenamed("id", "component"), "component", "left").select("component", F.coalesce("top", "component").alias("top"))
    inner = _onto(labels, "id", tops).select("id", F.col("top").alias("component"))
    return inner.unionByName(fresh)


def _size_class(percent: int) -> Column:
    """Sets that link lie in the same class of sizes or in neighbouring ones."""
    return F.floor(F.log("n_shingles") / F.lit(-math.log(min(percent, 99) / 100)))


def _across(hot: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Groups of large buckets whose nodes aren't all joined: blocks of the nodes outside the largest component against blocks of all, by size.

    Rows of ``hot`` carry their ``_size_class``.
    """
    own = table(_components_of(hot.select("bucket", "node", "band", "size"), labels), "near-mixed")
    per = own.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = table(per.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("largest")).filter("comps > 1"), "near-largest")
    own = own.join(mixed, "bucket")
    right = own.select("bucket", "node", "band", "comp", "size")
    left = own.filter("comp <> largest").select("bucket", "node", "band", "comp", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    half = max(1, block // 2)
    lefts, rights = (df.groupBy("bucket", "size").agg(F.count(F.lit(1)).alias(name)) for df, name in ((left, "l"), (right, "r")))
    # where few are left, a block takes more of the others instead
    others = F.greatest(F.lit(1), F.lit(block) - F.least("l", F.lit(half)))
    counts = rights.join(lefts, ["bucket", "size"]).select("bucket", "size", F.ceil(F.col("l") / F.lit(half)).alias("lefts"), F.ceil(F.col("r") / others).alias("rights"))
    counts = table(counts, "near-counts")

    def dealt(rows: DataFrame, mine: str, other: str, side: int) -> DataFrame:
        rows = rows.join(counts, ["bucket", "size"]).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(2)), F.col(mine)))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        ends = ("mine", "other") if side == 0 else ("other", "mine")
        return rows.select(F.xxhash64("bucket", "size", *ends).alias("group"), "node", "band", F.lit(side).alias("side"), "comp")

    return dealt(left, "lefts", "rights", 0).unionByName(dealt(right, "rights", "lefts", 1))


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased; a set has the distinct five-word
    shingles, of a shorter text the whole sequence; a null or wordless text has an empty set and no links. Texts link
    when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable by links, kept says that a
    row carries it (rows that repeat that doc_id all do). A null doc_id never names a component unless all its rows are
    null. Other columns aren't read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = table(docs.mapInArrow(_sketch(ROWS * bands(percent)), "doc_id long, n_shingles long, node binary, sig binary"), "near-rows")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"))
    nodes = table(nodes, "near-nodes").withColumn("shared", F.col("n_shingles"))
    # buckets of more than one node
    width = 4 * ROWS
    values = F.array(*[F.xxhash64(F.substring("sig", 1 + b * width, width), F.lit(b)) for b in range(bands(percent))])
    # a class of sizes goes along, so that the rows of large buckets needn't meet their nodes again
    banded = nodes.select("node", _size_class(percent).alias("size"), F.posexplode(values).alias("band", "bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = table(banded.join(crowded, "bucket"), "near-buckets")
    groups = met.filter(F.col("n") <= block).select(F.col("bucket").alias("group"), "node", "band", F.lit(-1).alias("side"), F.col("node").alias("comp"))
    hot = met.filter(F.col("n") > block)
    large = not hot.isEmpty()
    links = _links(groups.unionByName(_stars(hot, block)) if large else groups, nodes, docs, percent)
    labels = components(links, "a", "b")
    if large:
        labels = table(labels, "near-first")
        crowd = _shared(hot, nodes, docs)
        able = crowd.filter(100 * F.col("shared") >= percent * F.col("n_shingles")).select("node")
        more = _links(_across(hot.join(able, "node", "left_semi"), labels, block), crowd, docs, percent)
        labels = labels if more.isEmpty() else _contracted(labels, more)
    gone(met)
    least = nodes.join(labels.withColumnRenamed("id", "node"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = table(_onto(labels.withColumnRenamed("id", "node"), "node", least).select("node", "component_id"), "near-labels")
    out = rows.select("doc_id", "n_shingles", "node").join(nodes.select("node", "least"), "node", "left").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def survivors(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that carry their component's doc_id by ``near_duplicates``, with all their columns, which may have any names.

    Of rows that repeat that doc_id one stays. A null, empty or wordless text is its own component and stays. An empty table gives no rows.
    """
    kept = table(near_duplicates(docs, percent).filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "near-kept")
    few = kept.count() <= BROADCAST_IDS
    single = kept.filter("n = 1")
    out = docs.join(F.broadcast(single) if few else single, docs["doc_id"].eqNullSafe(single["doc_id"]), "left_semi")
    several = kept.filter("n > 1")
    if not several.isEmpty():
        more = docs.join(several, docs["doc_id"].eqNullSafe(several["doc_id"]), "left_semi")
        out = out.unionByName(more.dropDuplicates(["doc_id"]))
    return out
