"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie held as a table of edges.

A state is (word, position, node, edits). Nodes are beginnings of words; an edge has the letters between two nodes that branch, end a word or can
be a start, so a walk has as many levels as there are such nodes on its way, not as many as letters. A pair one edit apart shares its first or its last half:
every word starts behind its first half in a trie of the words, and behind its last half in a trie of the words read backwards, so no state ever
leaves a node near the root by all its edges. Each level is one equi-join: a state without an edit takes all edges of its node, one with its edit spent
takes the edge with its next letter. An edge knows the letters and the lengths that follow it, so that states without a future aren't kept. States that
end a word with one edit are neighbours. Nodes are named by 64-bit hashes; as pairs are confirmed on the words, two nodes of one name do no harm.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import gone, small_batches, table

#: Letters of words: a byte of Latin-1 text to itself, A-Z to a-z, and anything else to a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _words(drop: int, least: int, hold: int = 200_000):
    """mapInArrow function: (word, n) of a task's texts, given out whenever ``hold`` words have come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for w, n in Counter(text.as_py().encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(w) < least:
                        continue
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if drop and h % drop == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) < least:
                            continue
                    sums[w] = sums.get(w, 0) + n
                if len(sums) >= hold:
                    yield out()
                    sums.clear()
        yield out()

    return run


def words(docs: DataFrame, drop: int = 199, least: int = 6, often: int = 5) -> DataFrame:
    """(word, n) of the runs of ``[A-Za-z\\u00C0-\\u00FF]`` with at least ``least`` code points and ``often`` occurrences, A-Z lower-cased.

    Of a run whose crc32 of ``<doc_id>:<run>`` is a multiple of ``drop`` one letter is left out (0: of none). A null doc_id counts as empty text there.
    Each task sums its texts before anything is shuffled, so a word that is everywhere is one row a task.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    counts = own.mapInArrow(_words(drop, least), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def _node(side: Column, letters: Column, depth: Column) -> Column:
    return F.xxhash64(side, F.substring(letters, F.lit(1), depth))


def _length_bit(left: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(left, F.lit(63)))


def _edges(keys: DataFrame) -> DataFrame:
    """(node, label, child, after, lengths, ends) of both tries from where a walk can start.

    after: the letters that follow child; lengths: bits of how many letters can follow; ends: the word that ends at child, else null.
    """
    size, turned = F.length("letters"), F.col("side") == "<"
    low = (F.when(turned, size).otherwise(size - 1) / 2).cast("int")
    ways = keys.select("side", "letters", F.explode(F.sequence(low, size)).alias("depth"))
    ways = ways.select("side", "letters", "depth", _node(F.col("side"), F.col("letters"), F.col("depth")).alias("node"))
    start = F.col("depth") <= (F.when(turned, size + 2).otherwise(size + 1) / 2).cast("int")
    following = F.substring("letters", F.col("depth") + 1, F.lit(1))
    # letters first, then nodes: a node under very many words is a row for each letter
    letters = ways.groupBy("node", following.alias("next")).agg(F.max(start).alias("start"), F.bit_or(_length_bit(size - F.col("depth"))).alias("lengths"))
    nodes = letters.groupBy("node").agg(F.max("start").alias("start"), F.min("next").alias("a"), F.max("next").alias("z"), F.array_join(F.collect_list("next"), "").alias("after"), F.bit_or("lengths").alias("lengths"))
    nodes = table(nodes.filter("start or a <> z or a = ''").select("node", "after", "lengths"), "trie-nodes")
    stops = ways.join(nodes.select("node"), "node").groupBy("side", "letters").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("stops"))
    steps = stops.select("side", "letters", "stops", F.posexplode(F.slice("stops", F.lit(1), F.size("stops") - 1)).alias("i", "a")).withColumn("z", F.element_at("stops", F.col("i") + 2))
    label = F.substring("letters", F.col("a.depth") + 1, F.col("z.depth") - F.col("a.depth"))
    ends = F.when(F.col("z.depth") == size, F.col("letters"))
    edges = steps.groupBy(F.col("a.node").alias("node"), label.alias("label"), F.col("z.node").alias("child")).agg(F.min(ends).alias("first"), F.max(ends).alias("last"))
    edges = edges.join(nodes.withColumnRenamed("node", "child"), "child")
    return edges.select("node", "label", "child", "after", "lengths", F.explode(F.array_distinct(F.array("first", "last"))).alias("ends"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of different words, both ways round, that differ by one inserted, deleted or replaced code point.

    words has distinct words without null; an empty table gives no rows.
    """
    spark = words.sparkSession
    keys = words.select(F.lit(">").alias("side"), F.col("word").alias("letters")).unionByName(words.select(F.lit("<").alias("side"), F.reverse("word").alias("letters")))
    edges = table(_edges(keys), "trie-edges")
    own = ("label", "child", "after", "lengths", "ends")
    # a state without an edit looks up its node, one with an edit its node and next letter
    looked_up = edges.select(F.col("node").alias("at"), *own).unionByName(edges.select(F.xxhash64("node", F.substring("label", 1, 1)).alias("at"), *own))
    # dealt once more, so that both sides of the join are plain shuffles and a node with very many states can be split
    looked_up = looked_up.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = (F.when(F.col("side") == "<", F.length("letters") + 1).otherwise(F.length("letters")) / 2).cast("int")
    front = keys.select("side", "letters", F.substring("letters", half + 1, F.length("letters")).alias("rest"), _node(F.col("side"), F.col("letters"), half).alias("node"), F.lit(0).alias("edits"))
    m, rest, label = F.length("label"), F.col("rest"), F.col("label")

    # ways over an edge: letter for letter, or with one edit and so many letters more or fewer than it has
    kinds = F.when(F.col("edits") == 0, F.array(*map(F.lit, ("same", "one more", "one other", "one less")))).otherwise(F.array(F.lit("same")))
    taken = m + F.when(F.col("kind") == "one more", 1).when(F.col("kind") == "one less", -1).otherwise(0)
    left, edits = F.length(rest) - F.col("taken"), F.when(F.col("kind") == "same", F.col("edits")).otherwise(1)
    future = (left > 0) & (F.col("lengths").bitwiseAND(_length_bit(left)) != 0) & (F.instr("after", F.substring(rest, F.col("taken") + 1, F.lit(1))) > 0)
    # the comparison comes last, as most ways have no future
    goes = (left >= 0) & ((edits == 0) | ((left == 0) & F.col("ends").isNotNull()) | future)
    goes &= F.when(F.col("kind") == "same", rest.startswith(label)).otherwise(F.levenshtein(F.substring(rest, F.lit(1), F.col("taken")), label, 1) == 1)
    # a word of at most three letters can lose its last one at its very start, before any edge
    short = front.filter(F.length("rest") == 1).select("side", "letters", F.substring("letters", F.lit(1), F.length("letters") - 1).alias("ends"))
    found, tables = short.join(keys.withColumnRenamed("letters", "ends"), ["side", "ends"]).select("side", "letters", "ends"), []
    while True:
        at = F.when(F.col("edits") == 0, F.col("node")).otherwise(F.xxhash64("node", F.substring("rest", 1, 1)))
        states = front.withColumn("at", at).join(looked_up, "at").withColumn("kind", F.explode(kinds)).withColumn("taken", taken).filter(goes)
        states = states.select("side", "letters", F.substring("rest", F.col("taken") + 1, F.length("rest")).alias("rest"), F.col("child").alias("node"), edits.alias("edits"), "ends")
        states = table(states, "trie-front")
        tables.append(states)
        ended = states.filter("edits = 1 and rest = '' and ends is not null").select("side", "letters", "ends")
        found = found.unionByName(ended)
        front = states.filter("edits = 0 or rest <> ''").drop("ends")
        if front.isEmpty():
            break
    turned = [F.when(F.col("side") == "<", F.reverse(c)).otherwise(F.col(c)).alias(n) for c, n in (("letters", "word"), ("ends", "near"))]
    pairs = table(found.select(*turned).distinct().filter(F.levenshtein("word", "near", 1) == 1), "trie-pairs")
    gone(edges, *tables)
    return pairs


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest in code-point order) if that n is at least ``times`` the word's, else null; root is the last
    of the forms that follow from the word, the word itself if it has none. words has distinct words with their n. Forms grow in n by that factor,
    so the roots are found in a few rounds of jumps, each twice as long.
    """
    words = table(words, "words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    holds = -F.col("best.less") >= times * F.col("n")
    out = words.join(best, "word", "left").select("word", F.when(holds, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, -F.col("best.less")).alias("form_n"))
    out = table(out, "forms")
    jumps = table(out.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        both = table(jumps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not both.filter("moved").isEmpty()
        gone(jumps)
        jumps = both
        if not moved:
            break
    return out.join(jumps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, drop: int = 199, least: int = 6, often: int = 5, times: int = 5) -> DataFrame:
    """``variants`` of the ``words`` of docs (doc_id, text; other columns aren't read).

    A null or empty text has no words; rows that repeat count each; an empty table gives no rows. Texts and words may be of any length.
    """
    return variants(words(docs, drop, least, often), times)
