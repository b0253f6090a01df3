"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids, one for each run of neighbouring keys.

A turn's id is the first 128 bits of the SHA-256 of its role and text, so no table of ids has to be joined; a conversation's key is the ids of its
turns in order. Distinct keys are dealt by range, so a run of neighbouring keys holds whole subtrees of the trie and, along the ways of its first and
last key, parts of nodes that other runs share. Each run builds an adaptive radix tree; only depths at which a turn ends give nodes. Nodes off
those two ways are final; what runs share are two ways a run, whose parts are summed by node and whose subtrees are summed along the ways. No first turn or
conversation, however common, meets in one task: copies of a conversation are one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.llm.common import gone, small_batches, table

WIDTH = 16
#: Bytes of keys and number of keys that a tree takes before the next one begins.
TREE_BYTES, TREE_KEYS = 32 << 20, 100_000
#: Children that each layout of a node has room for.
SMALL, MIDDLE, LARGE, FULL = 4, 16, 48, 256


class Node:
    """A node of an adaptive radix tree: compressed bytes before it, the key that ends at it, and children by next byte in the layout that their number asks for.

    Up to 4 and up to 16 children lie in a sorted array of bytes, up to 48 behind an index of 256 bytes, more in 256 places.
    """

    __slots__ = ("prefix", "key", "room", "index", "children")

    def __init__(self, prefix: bytes, key: int = -1):
        self.prefix, self.key, self.room, self.index, self.children = prefix, key, SMALL, bytearray(), []

    def get(self, byte: int) -> Node | None:
        if self.room == FULL:
            return self.children[byte]
        if self.room == LARGE:
            return self.children[self.index[byte] - 1] if self.index[byte] else None
        at = self.index.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte: int, child: Node) -> None:
        """Sets the child of a byte; a full node changes to the next layout first."""
        if self.room == FULL:
            self.children[byte] = child
        elif self.room == LARGE:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = child
            elif len(self.children) < LARGE:
                self.children.append(child)
                self.index[byte] = len(self.children)
            else:
                self.children = [self.children[i - 1] if i else None for i in self.index]
                self.room, self.index = FULL, bytearray()
                self.children[byte] = child
        elif (at := self.index.find(byte)) >= 0:
            self.children[at] = child
        elif len(self.children) < self.room:
            at = sum(x < byte for x in self.index)
            self.index.insert(at, byte)
            self.children.insert(at, child)
        elif self.room == SMALL:
            self.room = MIDDLE
            self.put(byte, child)
        else:
            places = bytearray(256)
            for i, x in enumerate(self.index):
                places[x] = i + 1
            self.room, self.index = LARGE, places
            self.put(byte, child)

    def below(self) -> list[Node]:
        """Children in order of their bytes."""
        if self.room == LARGE:
            return [self.children[i - 1] for i in self.index if i]
        return [c for c in self.children if c is not None]


def shared(a: bytes, b: bytes) -> int:
    """Length of what two byte strings begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def insert(root: Node, key: bytes, number: int) -> None:
    """Adds a key; a node whose compressed bytes the key leaves is split there."""
    node, at, parent, way = root, 0, None, 0
    while True:
        rest = key[at : at + len(node.prefix)]
        same = shared(node.prefix, rest)
        if same < len(node.prefix):
            upper = Node(node.prefix[:same])
            upper.put(node.prefix[same], node)
            node.prefix = node.prefix[same + 1 :]
            parent.put(way, upper)
            node = upper
        at += same
        if at == len(key):
            node.key = number
            return
        child = node.get(key[at])
        if child is None:
            node.put(key[at], Node(key[at + 1 :], number))
            return
        parent, way, node, at = node, key[at], child, at + 1


def summarise(keys: list[bytes], counts: list[int], firsts: list[int], lengths: list[list[int]], width: int) -> list[list]:
    """Nodes of the trie of sorted distinct keys, children before parents: [key that has it, depth, convs, conv_id, children, leaves, saved, key that ends, parent's place or -1, on an outer way].

    Sums of a node on an outer way (a beginning of the first or last key) leave out what lies below nodes that are on one too.
    """
    root = Node(b"")
    for i, k in enumerate(keys):
        insert(root, k, i)
    outer = [max(shared(k, keys[0]), shared(k, keys[-1])) // width for k in keys]
    nodes: list[list] = []
    # on the way down a node's depth in bytes; on the way up what its subtree has given: convs, conv_id, a key, tops (places of the uppermost nodes)
    stack, given = [(root, 0, 0, False)], {}
    while stack:
        node, above, depth, up = stack.pop()
        if not up:
            stack.append((node, above, depth, True))
            stack += [(c, depth, depth + 1 + len(c.prefix), False) for c in node.below()]
            continue
        parts = [given.pop(id(c)) for c in node.below()]
        convs, conv, key, tops = sum(p[0] for p in parts), min((p[1] for p in parts), default=None), parts[0][2] if parts else node.key, [t for p in parts for t in p[3]]
        if node.key >= 0:
            convs, conv = convs + counts[node.key], firsts[node.key] if conv is None else min(conv, firsts[node.key])
        # turns that end within this node's bytes, the deepest first
        for d in range(depth // width, above // width if node is not root else -1, -1):
            own = [nodes[t] for t in tops if not nodes[t][9]]
            ends = node.key if d * width == depth else -1
            cost = (convs - 1) * lengths[key][d - 1] if d else 0
            saved, leaves = sum(x[6] for x in own), sum(x[5] for x in own)
            out = d <= outer[key]
            for t in tops:
                nodes[t][8] = len(nodes)
            nodes.append([key, d, convs, conv, len(own) if out else len(tops), leaves if out else leaves or 1, saved if out else saved + cost, ends, -1, out])
            tops = [len(nodes) - 1]
        given[id(node)] = (convs, conv, key, tops)
    return nodes


_NODES = "outer boolean, tree long, side int, node string, depth long, up string, parent long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, length long, ends string"


def _name(at: list[str], key: bytes, width: int) -> list[str]:
    """Names of the beginnings of a key, turn by turn, in at."""
    h = hashlib.sha256()
    at.append(h.hexdigest()[:32])
    for i in range(0, len(key), width):
        h.update(key[i : i + width])
        at.append(h.copy().hexdigest()[:32])
    return at


def _trees(width: int):
    """mapInArrow function over sorted keys: each tree's nodes; those on an outer way by name, once with their sums and once more for each way."""

    def one(rows: list[tuple], tree: int) -> pa.RecordBatch:
        keys, counts, firsts, lengths, ends = map(list, zip(*rows, strict=True))
        nodes = summarise(keys, counts, firsts, lengths, width)
        ways = [_name([], keys[0], width), _name([], keys[-1], width)]
        out, named = [], set()
        for key, d, convs, conv, children, leaves, saved, end, parent, outer in nodes:
            length, digest = lengths[key][d - 1] if d else 0, ends[end] if end >= 0 else None
            if not outer:
                above = nodes[parent]
                up = ways[0 if shared(keys[key], keys[0]) >= above[1] * width else 1][above[1]] if above[9] else None
                out.append((False, tree, None, None, d, up, None if above[9] else above[3], conv, convs, children, leaves, saved, length, digest))
                continue
            for side, (way, end_key) in enumerate(zip(ways, (keys[0], keys[-1]), strict=True)):
                if d * width <= shared(keys[key], end_key):
                    sums = (conv, convs, children, leaves, saved) if way[d] not in named else (None, 0, 0, 0, 0)
                    named.add(way[d])
                    out.append((True, tree, side, way[d], d, way[d - 1] if d else None, None, *sums, length, digest))
        kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.string()]
        columns = list(zip(*out, strict=True))
        names = [x.split()[0] for x in _NODES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for key, n, first, lengths, ends in zip(*(b.column(c).to_pylist() for c in ("key", "n", "first", "lengths", "ends")), strict=True):
                rows.append((bytes.fromhex(key), n, first, lengths, ends))
                size += len(key) // 2
                if size >= TREE_BYTES or len(rows) >= TREE_KEYS:
                    yield one(rows, tree)
                    tree, rows, size = tree + 1, [], 0
        if rows:
            yield one(rows, tree)

    return run


def _segments(most: int = 1 << 16):
    """mapInArrow function over ids sorted within digests: pieces of comma-joined ids with their number and least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"digest": now, "first": ids[0], "n": len(ids), "piece": ",".join(map(str, ids))}], pa.schema([("digest", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("piece", pa.string())]))

        for b in batches:
            for digest, i in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (digest != now or size >= most):
                    yield out()
                    ids, size = [], 0
                now = digest
                ids.append(i)
                size += len(str(i)) + 1
        if ids:
            yield out()

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: per digest the least id, the number of ids and the SHA-256 of all pieces, comma-joined, which are read one after another."""
    now, first, n, h = None, 0, 0, None
    out: list[tuple] = []
    for b in batches:
        for digest, f, k, piece in zip(*(b.column(c).to_pylist() for c in ("digest", "first", "n", "piece")), strict=True):
            if digest == now:
                h.update(b",")
            else:
                if h is not None:
                    out.append((now, first, n, h.hexdigest()))
                now, first, n, h = digest, f, 0, hashlib.sha256()
            h.update(piece.encode())
            n += k
    if h is not None:
        out.append((now, first, n, h.hexdigest()))
    kinds = (("digest", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("ends", pa.string()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], [c for c, _ in kinds])


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """One row a conversation: conv_id, ids (hex of its turns' ids, in order), lengths (code points of their texts).

    A conversation c has the first h turns of conversation c - c % group, h = crc32 of c in decimals modulo ``most``, and then its own after its first h. Turns are
    in the order of turn, null first; turns of one number by id. A null role or text is empty; rows that repeat are turns each; rows without conv_id
    are passed over. A conversation is held in one row, as 32 hex digits and a number a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turns = conversations.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), turn.alias("id"), F.length(text).alias("length"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "length"))).alias("turns"))
    own = own.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.length").alias("lengths"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    base = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, most - 1).alias("base_ids"), F.slice("lengths", 1, most - 1).alias("base_lengths"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")

    def joined(c: str) -> DataFrame:
        head = F.coalesce(F.slice(f"base_{c}", F.lit(1), h), F.slice(c, F.lit(1), F.lit(0)))
        return F.concat(head, F.slice(c, h + 1, F.size(c))).alias(c)

    return own.join(base, "base", "left").select("conv_id", joined("ids"), joined("lengths"))


def trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """One row a node of the trie of the ``rebuilt`` conversations.

    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of the members that end there). Other
    columns than conv_id, turn, role and text aren't read. Without any conversation there is no node, not even the root.
    """
    small_batches(conversations.sparkSession, 10_000)
    built = rebuilt(conversations, group, most)
    built = table(built.select("conv_id", F.array_join("ids", "").alias("key"), "lengths").withColumn("digest", F.sha2("key", 256)), "trie-built")
    # copies of a conversation are one key; their ids are joined in pieces first, so that very many copies are few rows
    pieces = built.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_segments(), "digest string, first long, n long, piece string")
    ends = pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_ends, "digest string, first long, n long, ends string")
    keys = table(built.join(ends.select(F.col("first").alias("conv_id"), "first", "n", "ends"), "conv_id").select("key", "n", "first", "lengths", "ends"), "trie-keys")
    nodes = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_trees(WIDTH), _NODES)
    nodes = table(nodes, "trie-nodes")

    ways = nodes.filter("outer")
    path = F.struct("tree", "side")
    own = ways.groupBy("node").agg(
        F.max("depth").alias("depth"), F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("length").alias("length"), F.max("ends").alias("ends"), F.min(path).alias("path"),
    )
    children = own.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    own = own.join(children, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = own.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("length"))
    own = table(own, "trie-outer")
    # each node counts on the first of its ways only; a node's subtree is what all ways through it have from there on
    counted = F.col("path") == path
    steps = ways.select("node", "tree", "side", "depth").join(own.select("node", "path", "n_leaves", "saved"), "node")
    rest = W.partitionBy("tree", "side").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.select("node", *[F.sum(F.when(counted, F.col(c)).otherwise(0)).over(rest).alias(c) for c in ("n_leaves", "saved")])
    sums = steps.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    named = own.select(F.col("node").alias("up"), F.col("conv_id").alias("upper"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    shared_nodes = own.drop("n_leaves", "saved").join(sums, "node").join(named, "up", "left").withColumn("parent_conv_id", F.col("upper"))
    # the upper nodes of final ones are dealt once more, so that one under which very many lie can be split
    named = named.repartition(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    final = nodes.filter("not outer").join(named, "up", "left").withColumn("parent_conv_id", F.coalesce("parent", "upper"))
    out = table(shared_nodes.select(*columns).unionByName(final.select(*columns)), "trie")
    gone(built, keys, nodes, own)
    return out
