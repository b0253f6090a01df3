"""Every operator of the subpackage against brute force on small tables, with nulls, empty and long texts, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from govlens.llm import ctw, decontam, linear, linededup, minhash, packing, quality, ring, streamdedup, toxicity, urls
from govlens.llm import text as T
from govlens.llm.queries import tokenizer_path

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, digest string, norm string, n long, chunk string, node string, grade string, count long, seen long, mark string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def sentence(rng, n=30):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng) for _ in range(12)]
    near = [b + " extra" for b in base[:4]] + [base[0] + " other tail", base[1].upper()]
    texts = base + near + ["", None, " \n ", "One", "one", "a b c", "x" * 30_000, sentence(rng, 6000), "é ß 漢字 é", base[0]]
    out = list(enumerate(texts, 1))
    return [*out, (None, "no id"), (3, texts[2]), (7, "other text of seven")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "d", "n", 1, "c", "o", "g", 2, 3, "m") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles_match_python(rows):
    texts = [t for _, t in rows]
    data, off = T.buffers(pa.array(texts, pa.string()))
    _, _, at = T.spans(data, off)
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    for t, s in zip(texts, T.shingle_sets(data, off), strict=True):
        w = words(t)
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    seen = {}
    for t, h in zip([w for t in texts for w in words(t)], T.hashes(data, *T.spans(data, off)[:2]).tolist(), strict=True):
        assert seen.setdefault(t, h) == h
    assert len(set(seen.values())) == len(seen)


def test_exact_dedup(docs, rows, empty):
    got = streamdedup.dedup(docs).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    by_hash = {sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = Counter()
    for r in got:
        own = by_hash[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    left = streamdedup.survivors(docs)
    assert left.columns == docs.columns and left.count() == len(groups) and {r.digest for r in left.collect()} == {"d"}
    assert streamdedup.dedup(empty).count() == 0


def test_exact_dedup_state_goes_on(spark, tmp_path):
    docs = lambda rows: streamdedup.entries(spark.createDataFrame(rows, "doc_id long, text string"))
    src, check, sink = f"{tmp_path}/src", f"{tmp_path}/check", f"{tmp_path}/sink"
    docs([(1, "a"), (2, "A"), (3, "b")]).write.parquet(src)
    first = {r.best.doc_id: r.seen for r in streamdedup.keep_state(spark, src, check, sink).collect()}
    docs([(9, "a"), (4, "c")]).write.mode("append").parquet(src)
    then = {r.best.doc_id: r.seen for r in streamdedup.keep_state(spark, src, check, sink).collect()}
    assert first == {2: 2, 3: 1} and then == {9: 3, 3: 1, 4: 1}


def test_near_duplicates(docs, rows, empty, monkeypatch):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    component = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = Counter((rows[i][0], len(sets[i]), component[root[i]], rows[i][0] == component[root[i]]) for i in range(len(rows)))
    for block in (minhash.BLOCK, 2):
        got = minhash.near_duplicates(docs, block=block).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    left = minhash.survivors(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for c in component.values()}
    assert minhash.near_duplicates(empty).count() == 0


def test_one_large_bucket_of_near_copies(spark):
    """Far more near copies than a block holds, two groups of them and texts that share half of their words with one."""
    rng = random.Random(31)
    base, other = sentence(rng, 200).split(), sentence(rng, 200).split()
    texts = [" ".join([*base[:k], f"w{i}", *base[k + 1 :]]) for i in range(2500) for k in (rng.randrange(200),)]
    texts += [" ".join([*other[:k], f"v{i}", *other[k + 1 :]]) for i in range(900) for k in (rng.randrange(200),)]
    texts += [" ".join([*base[:130], *sentence(rng, 70).split()]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, block=64).collect()}
    assert {got[i] for i in range(2500)} == {0} and {got[i] for i in range(2500, 3400)} == {2500}
    assert all(got[i] == i for i in range(3400, 3800))


def test_bridges_between_components_of_a_large_bucket(spark):
    """A chain whose ends don't link, in a bucket that is cut into the smallest blocks: brute force finds the same components."""
    rng = random.Random(33)
    w = sentence(rng, 150).split()
    texts = []
    for _ in range(60):
        w = list(w)
        for _ in range(2):
            w[rng.randrange(150)] = sentence(rng, 1)
        texts.append(" ".join(w))
    sets = [frozenset(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (words(t) for t in texts)]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min(i for i in range(60) if root[i] == r) for r in set(root)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (2, 7):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, block=block).collect()} == {i: least[root[i]] for i in range(60)}


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    same = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
    assert abs(same - 0.6) < 0.07


def test_signature_floor_loses_less_than_the_bands():
    size = minhash.BANDS * minhash.ROWS
    below = sum(math.comb(size, k) * 0.85**k * 0.15 ** (size - k) for k in range(math.ceil(minhash.LIKELY * size - 1e-9)))
    assert below < (1 - 0.85**minhash.ROWS) ** minhash.BANDS / 10


def test_ring(docs, rows, empty, spark):
    got = ring.assign(docs, shards=5).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert ring.assign(empty).count() == 0
    for few in (3, 40):  # positions in cuts: the same counts and slots
        cut = ring.assign(docs, shards=5, bits=2, ranked=few).collect()
        assert Counter(r.shard for r in cut) == counts and all(sorted(r.slot for r in cut if r.shard == s) == list(range(counts[s])) for s in counts)
    hot = spark.range(900).select((F.col("id") * 0).alias("doc_id"), F.lit("x").alias("text"))
    for ranked in (ring.RANKED, 50):
        assert [r["count"] for r in ring.assign(hot, 24, ranked=ranked).groupBy("shard").count().collect()].count(37) == 12


def test_ring_walk_is_a_walk_row_by_row():
    """Independent of the walk by counts: each row goes to its home if it is among the first there, then clockwise to the next shard with room."""
    rng = random.Random(19)
    counts = {rng.randrange(256): rng.randint(1, 40) for _ in range(60)}
    shards, bits = 5, 8
    nodes = ring.virtual_nodes(shards, 7, bits)
    total = sum(counts.values())
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    homes = {p: next((k for k, (at, _) in enumerate(nodes) if at >= p), 0) for p in counts}
    where, late = {}, []
    for p in sorted(counts):
        for r in range(counts[p]):
            s = nodes[homes[p]][1]
            if room[s]:
                room[s] -= 1
                where[p, r] = s
            else:
                late.append((p, r))
    for p, r in late:
        k = homes[p]
        while not room[nodes[k][1]]:
            k = (k + 1) % len(nodes)
        room[nodes[k][1]] -= 1
        where[p, r] = nodes[k][1]
    got = {(p, r): s for p, s, first, n in ring.walk(counts, shards, 7, bits) for r in range(first, first + n)}
    assert got == where


def test_ring_moves_little():
    rng = random.Random(2)
    counts = dict(Counter(rng.randrange(1 << 16) for _ in range(50_000)))

    def shard_of(shards):
        return {(p, r): s for p, s, first, n in ring.walk(counts, shards) for r in range(first, first + n)}

    a, b = shard_of(24), shard_of(25)
    assert len(a) == len(b) == 50_000
    assert sum(a[k] != b[k] for k in a) < 0.25 * len(a)


def test_urls(spark):
    pages = [(1, "http://a.net/x"), (2, "https://www.Example.NET/en/1?q=/de/"), (3, "http://example.com/de/"), (4, "http://example.com/de"), (5, None), (6, "nothing"), (7, "http://x.org/fr/#a"), (8, "http://net"), (9, "http://badexample.com/de/1"), (9, "http://badexample.com/de/1"), (10, "ftp://u@h.net:80/"), (11, "http://example.net/"), (None, "http://q.net/"), (20, "http://a.net/" + "x" * 50_000 + "?q"), (21, "https://" + "a." * 3000 + "org/fr/"), (22, "")]
    pages += [(i, None) for i in range(30, 60)] + [(i, "http://hot.net/x") for i in range(60, 90)]
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in pages], "page_id long, url string, host string, path string, rule string")
    got = Counter(tuple(r) for r in urls.judge(df, urls.rule_table(spark)).collect())
    want = Counter()
    for i, u in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want[i, host, path, best[1], best[2]] += 1
    assert got == want
    assert urls.judge(df.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judge(df, urls.rule_table(spark, [])).collect()} == {"allow"}


def test_token_ids_equal_the_tokenizer(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [x or "" for _, x in rows] + ["one <|endoftext|> two", "<|endoftext|><|endoftext|>\n\n<|endoftext|>  x", "a<|endoftext|>b <|endoftext| >", "  a  b\n\n c  x <|endoftext|> don't a b \x1c z 12  ", "\n\n\n  ", "²³ é́ x'll\r\n\tq", "a\nB\n\nC \n d", "ab,cd.  Ef'll 3x", "naïveЖ, o’k  x"]
    want = [np.array([*e.ids, 0], "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert packing.token_ids(texts, tokenizer_path()) == want
    assert len(packing.token_ids(["one <|endoftext|> two"], tokenizer_path())[0]) == 4 * (len(t.encode("one <|endoftext|> two", add_special_tokens=False).ids) + 1)


def test_packing(docs, rows, empty):
    got = packing.pack(docs, tokenizer_path(), part=8).collect()
    ids = Counter((i, packing.token_ids([t or ""], tokenizer_path())[0]) for i, t in rows)
    want = Counter()
    for (i, raw), n in ids.items():
        for k, (s, size) in enumerate(packing.cuts(len(raw) // 4)):
            want[i, k, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)])] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    sizes = np.array([r.length for r in got])
    assert packing.lower_bound(sizes) <= len(places) <= packing.lower_bound(sizes) + 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_packed_sequences_hold_the_ids(spark, rows):
    own = spark.createDataFrame([(i, t) for i, t in enumerate(t for _, t in rows)], "doc_id long, text string")
    packed = packing.pack(own, tokenizer_path())
    whole = {r.sequence_id: r.ids for r in packing.sequences(own, packed, tokenizer_path()).collect()}
    for r in packed.collect():
        assert zlib.crc32(np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32


def test_exchange_goes_on_to_one_part(spark):
    rng = random.Random(23)
    docs = spark.createDataFrame([(i, sentence(rng, rng.randint(1, 400))) for i in range(400)], "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path(), part=40).collect()
    sizes = np.array([r.length for r in got])
    assert len({r.sequence_id for r in got}) <= packing.lower_bound(sizes) + 2 and sorted({(r.doc_id, r.piece) for r in got}) == sorted((r.doc_id, r.piece) for r in got)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for lo, hi in ((1, 2048), (600, 1500), (1025, 2047), (1, 50)):
        sizes = rng.integers(lo, hi, 400)
        bins, offsets, filled = packing.best_fit_decreasing(sizes)
        assert packing.lower_bound(sizes) <= len(filled) and max(filled) <= 2048 and sum(filled) == sizes.sum()
        for b in range(len(filled)):
            assert sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))[0][0] == 0
    assert packing.lower_bound(np.full(10, 1025)) == 10 and packing.lower_bound(np.array([], int)) == 0


def test_context_tree_weighting(spark):
    table = [(1, "Ab ab b"), (2, None), (3, "abc  abd\n é"), (4, ""), (5, "ab ab ab ab q"), (6, "zz é"), (7, " "), (8, "ab"), (None, "ab")]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in table], "doc_id long, text string, chunk string, score long")
    depth, mod = 3, 4
    got = {r.doc_id: r for r in ctw.score(docs, depth=depth, mod=mod).collect()}
    crc = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % mod
    train = [t for i, t in table if crc(i)]
    seq = lambda t: bytes([10] * depth) + " ".join(words(t)).encode() + b"\n"
    count = defaultdict(lambda: [0, 0])
    for t in train:
        b = seq(t)
        for k in range(depth, len(b)):
            for i in range(8):
                p = (1 << i) | (b[k] >> (8 - i))
                for d in range(depth + 1):
                    count[b[k - d : k], p][(b[k] >> (7 - i)) & 1] += 1
    kids = defaultdict(set)
    for c, p in count:
        if c:
            kids[c[1:], p].add((c, p))

    def own(n):
        a, b = count[n]
        return (math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1)) / math.log(2) - math.log2(math.pi)

    def weighted(n):
        return own(n) if len(n[0]) == depth else np.logaddexp2(own(n), sum(weighted(k) for k in kids[n])) - 1

    def prob(context, p, bit, d=0):
        n = (context[depth - d :], p)
        if n not in count:
            return 0.5
        k = count[n]
        e = (k[bit] + 0.5) / (sum(k) + 1)
        if d == depth or (context[depth - d - 1 :], p) not in count:
            return e
        share = 1 / (1 + 2 ** -(own(n) - sum(weighted(x) for x in kids[n])))
        return share * e + (1 - share) * prob(context, p, bit, d + 1)

    tokens = Counter(w for t in train for w in [*words(t), "\n"])
    n = sum(tokens.values())
    for i, t in table:
        b = seq(t)
        want = sum(math.log10(prob(b[k - depth : k], (1 << j) | (b[k] >> (8 - j)), (b[k] >> (7 - j)) & 1)) for k in range(depth, len(b)) for j in range(8))
        w = [*words(t), "\n"]
        base = sum(math.log10((tokens[x] + 0.1) / (n + 0.1 * (len(tokens) + 1))) for x in w)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) == 0, len(w), sum(tokens[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - want) < 1e-4
    assert ctw.score(docs.limit(0)).count() == 0


def test_ctw_deals_repeated_rows(spark):
    dealt, chunks = ctw.deal(spark.range(10_000).selectExpr("cast(null as long) as doc_id", "'one text' as text"), chunk_bytes=2000)
    per = [r["count"] for r in dealt.groupBy("chunk").count().collect()]
    assert chunks == 40 and len(per) == 40 and max(per) < 400 and sum(per) == 10_000


def test_ctw_by_runs_of_chunks(spark, monkeypatch):
    """Chunks of a few bytes in runs of three, and one run of all, give the same scores."""
    rng = random.Random(14)
    docs = spark.createDataFrame([(i, sentence(rng, rng.randint(0, 40))) for i in range(80)], "doc_id long, text string")
    whole = {r.doc_id: r for r in ctw.score(docs).collect()}
    monkeypatch.setattr(ctw, "RUN", 3)
    split = {r.doc_id: r for r in ctw.score(docs, chunk_bytes=500).collect()}
    for i, r in whole.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (split[i].n_tokens, split[i].n_known, split[i].train_tokens)
        assert abs(r.score - split[i].score) < 1e-3 and abs(r.base_score - split[i].base_score) < 1e-9


def test_ctw_is_a_distribution():
    keys = np.array([(97 << 16) | (98 << 8) | b for b in (97, 98, 99)], np.uint64)
    tree = ctw.grow(keys, np.array([3, 1, 2]), 2, least=2)
    root = tree[2]
    low = ctw._fold((root["nodes"] >> np.uint64(16) << np.uint64(8)) | (root["nodes"] & np.uint64(255)), root["n0"], root["n1"], root["weighted"])
    top = ctw.crown(low["nodes"], low["n0"], low["n1"], low["weighted"])
    two = root["nodes"]
    at = ((two >> np.uint64(16)).astype(int), (two & np.uint64(255)).astype(int))
    ctw.spread(tree, 2, top["mixed"][at], top["rest"][at])
    every = np.array([(97 << 16) | (98 << 8) | b for b in range(256)], np.uint64)
    assert abs(np.exp2(ctw.resolve(every, tree, top, 2)).sum() - 1) < 1e-9


def test_wand_finds_what_exhaustive_scoring_finds():
    rng = random.Random(4)
    items = [sentence(rng, rng.randint(3, 60)).replace(" ", "\n", 1) for _ in range(120)] + ["", None]
    index = decontam.build(list(range(len(items))), items)
    dense = np.zeros((len(index.terms), len(items)))
    for t, (i, w) in enumerate(zip(index.items, index.weights, strict=True)):
        dense[t, i] = w
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), 30))
        for threshold in (1.0, 0.5, 0.2):
            want = set(np.flatnonzero(dense[terms].sum(0) >= threshold).tolist())
            assert {i for i, _ in decontam.search(index, terms, threshold)} == want
        best = decontam.bounds(index, np.zeros(30, np.int64), np.array(terms), 1)[0]
        assert best >= dense[terms].sum(0).max() - 1e-9


def test_leaks(spark, empty):
    rng = random.Random(6)
    items = [(i, sentence(rng, 25) + ".\n" + sentence(rng, 8)) for i in range(30)] + [(30, None), (31, "")]
    filler = lambda n: sentence(rng, n)
    w = items[3][1].split()
    docs = [(1, filler(300) + " " + items[0][1].upper() + " " + filler(200)), (2, filler(500)), (3, items[1][1]), (4, None), (5, ""), (6, " ".join(w[:16]) + " " + filler(40)), (7, " ".join([*w[:-1], "changed"])), (None, items[2][1]), (8, filler(90) + " " + items[4][1] + " " + filler(10) + " " + items[5][1]), (8, filler(5000))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id long, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def share(text, part):
        a, b = words(text), words(part)
        n = min(5, len(b))
        own = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        return len(own & {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}) / len(own) if own else 0

    want = {(i, k) for i, t in docs for k, x in items if x and share(t, x) >= 0.8}
    rounded = lambda rows: sorted(str({**r.asDict(), "score": round(r.score, 9)}) for r in rows)
    whole = rounded(decontam.leaks(df, bench).collect())
    for most in (decontam.INDEX_ITEMS, 20, 7):
        found = decontam.leaks(df, bench, most).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        # neither scores nor windows hang on how items are parted
        assert rounded(found) == whole
    assert (7, 3) in want and (6, 3) not in want
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6, 8]
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_line_chunks(spark, empty):
    rng = random.Random(7)
    line = lambda: sentence(rng, 6)
    passage = [line() for _ in range(12)]
    docs = [(i, "\n".join([*[line() for _ in range(i)], *passage, *[line() for _ in range(3)]])) for i in range(1, 6)]
    docs += [(6, None), (7, ""), (8, "one line"), (9, "\n\n"), (None, "\n".join(passage)), (1, docs[0][1])]
    df = spark.createDataFrame([(i, t, "f", "l", "m") for i, t in docs], "doc_id long, text string, first string, lines string, mark string")
    got = linededup.dedup(df).collect()
    assert len(got) == len(docs)
    text = {}
    for r in got:
        text.setdefault(r.doc_id, []).append(r)
    assert text[6][0].text is None and text[8][0].text == "one line" and text[1][0].text == text[1][1].text
    for i in range(2, 6):
        r, own = text[i][0], dict(docs)[i].split("\n")
        left = r.text.split("\n")
        assert r.n_lines == len(own) and r.removed_lines == len(own) - len(left)
        assert [x for x in own if x not in passage] == [x for x in left if x not in passage]  # nothing else goes
    assert sum(r.removed_lines for r in got) > 0
    removed = {x for i in range(2, 6) for x in passage if x not in text[i][0].text.split("\n")}
    assert removed and all(any(x in (r.text or "").split("\n") for r in got) for x in removed)  # one copy stays
    assert linededup.dedup(empty).count() == 0


def test_chunk_boundaries_resist_shifts(spark):
    rng = random.Random(21)
    body = [sentence(rng, 4) for _ in range(300)]
    texts = {0: body, 1: [sentence(rng, 4), *body], 2: [*body[:150], sentence(rng, 4), *body[150:]], 3: body[:1], 4: body[:2], 5: body[:3], 6: body[:4]}
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "i int, text string")
    starts = {r.i: r.s for r in linededup.with_chunk_starts(df.select("i", linededup.lines_of(F.col("text")).alias("lines"))).select("i", F.col("starts").alias("s")).collect()}
    for i in (0, 1, 2):
        sizes = np.diff([*starts[i], len(texts[i])])
        assert starts[i][0] == 0 and sizes[1:].min() >= 2 and 2.5 < sizes.mean() < 3.6
    at = [{texts[i][k] for k in starts[i][1:]} for i in range(3)]
    assert len(at[0] ^ at[1]) <= 2 and len(at[0] ^ at[2]) <= 4
    assert starts[3] == starts[4] == starts[5] == [0]


def test_line_dedup_recall_of_repeated_pairs(spark):
    """Of all adjacent lines of a whole table that repeat, by brute force, how many go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = [(r.text or "").split("\n") for r in docs.select("text").collect()]
    after = [(r.text or "").split("\n") for r in linededup.dedup(docs).collect()]
    assert {x for t in before for x in t} <= {x for t in after for x in t}  # every line is left somewhere

    def again(texts):
        n = Counter(p for t in texts for p in zip(t, t[1:]))  # noqa: B905
        return sum(k - 1 for k in n.values())

    assert again(before) > 500 and again(after) <= 0.1 * again(before)


def test_repeated_and_very_long_test_items(spark):
    rng = random.Random(16)
    same, long = sentence(rng, 30), sentence(rng, 20_000)
    items = spark.createDataFrame([(i, same) for i in range(5000)] + [(None, same), (7000, long), (7001, long), (7001, None), (7002, " ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, sentence(rng, 50) + " " + same), (2, long + " tail"), (3, " ".join(long.split()[:9000])), (4, sentence(rng, 3000))], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r["items"]) for r in decontam.leaks(docs, items).collect()) == [(1, 0, 5001), (2, 7000, 2)]
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, items, most=1).collect()) == [(1, 0), (2, 7000)]
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [3, 4]


def test_planted_passages_go_whole(spark):
    rng = random.Random(11)
    line = lambda n=6: sentence(rng, n)
    passages = [[line() for _ in range(n)] for n in range(2, 7) for _ in range(8)] + [[line(n)] for n in (50, 51, 120, 49)]
    hosts = [(p, copy, [line() for _ in range(rng.randint(1, 3))], [line() for _ in range(rng.randint(1, 3))]) for p in passages for copy in range(3)]
    docs = [(i, "\n".join([*a, *p, *z])) for i, (p, _, a, z) in enumerate(hosts)]
    tight = [line(), line()]  # a text that repeats itself: no line is left that stands nowhere else
    docs += [(900, "\n".join([tight[0]] * 3)), (901, "\n".join(tight * 3)), (902, "\n".join([tight[1], tight[0], line()]))]
    left = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (p, copy, a, z) in enumerate(hosts):
        goes = copy > 0 and (len(p) > 1 or len(words(p[0])) >= 50)
        assert left[i].text.split("\n") == [*a, *([] if goes else p), *z]
        assert (left[i].removed_chunks, left[i].removed_lines) == ((1, len(p)) if goes else (0, 0))
    assert left[900].removed_lines == 0 and left[901].text.split("\n") == tight and left[902].removed_lines == 2
    assert {x for _, t in docs for x in t.split("\n")} == {x for r in left.values() for x in r.text.split("\n")}


def _labelled(spark, n=300, grades=3):
    rng = random.Random(8)
    marks = ["plain", "fine", "great"]
    rows = [(i, sentence(rng, 20) + f" {marks[i % grades]}", i % grades) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "g") for i, t, _ in rows] + [(n, None, "g"), (n + 1, "", "g"), (None, "great", "g")], "doc_id long, text string, grade string")
    return docs, spark.createDataFrame([(i, g, int(g > 0)) for i, _, g in rows] + [(None, 1, 1), (5, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")


def test_ordinal_grades(spark, empty):
    docs, ratings = _labelled(spark)
    model = quality.train(docs, ratings)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0 and i != 7]
    assert sum(round(got[i].expected_grade) == i % 3 for i in held) >= 0.95 * len(held)
    assert all(got[i].accepted == (i % 3 == 2) for i in held)
    assert 0 <= got[300].p_accept <= 1 and got[300].p_accept == got[301].p_accept
    assert {r.doc_id for r in quality.accepted(docs, model).collect()} == {i for i, r in got.items() if r.accepted}
    none = quality.train(docs, ratings.limit(0))
    assert quality.score(docs, none).filter("accepted").count() == 303 and quality.accepted(docs, none).count() == 303
    assert quality.score(empty, model).count() == 0


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, (2000, 3))
    s = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=2000)
    grade = (s > -0.5).astype(int) + (s > 1.5).astype(int)
    rows, features = np.nonzero(x)
    w, theta = linear.fit_ordinal(rows, features, grade, 3, 3)
    assert abs(w[0] - 2) < 0.4 and abs(w[1] + 1) < 0.4 and abs(w[2]) < 0.3 and theta[0] < theta[1]


@pytest.fixture(scope="module")
def characters(spark):
    base = "you are an idiot and stupid loser what a moron trash pathetic scum worthless clown disgusting words here good letter committee "
    docs = spark.createDataFrame([(i, base) for i in range(50)], "doc_id long, text string")
    return toxicity.character_model(docs)


def test_lattice_decoding(characters):
    read = {
        "You 1d10t, $tup1d m0r0n!": "You idiot, stupid moron!", "i d i o t": "idiot", "stuuuupid l.o.s.e.r": "stupid loser", "plain words here": "plain words here", None: "", "": "",
        "2024-01-02 3.14 $100 1 2 3 4 5": "2024-01-02 3.14 $100 1 2 3 4 5", "idi" + "o" * 70 + "t": "idiot", "idi" + "o" * 5000 + "t": "idiot", "i$$$$d10t": "idiot", "iddiiott": "idiot", "ssttuuppiidd": "stupid",
        "y o u a r e a n i d i o t": "you are an idiot", "y o u  a r e  s c u m": "you are scum", "good letter committee": "good letter committee",
    }
    texts = list(read)
    assert toxicity.Restorer(characters).restore(pa.array(texts)) == [read[t] for t in texts]
    spaced = " ".join("you are an idiot and stupid loser what a moron trash".replace(" ", ""))  # far more than 32 letters
    assert toxicity.Restorer(characters).restore(pa.array([spaced])) == ["you are an idiot and stupid loser what a moron trash"]


def test_long_words_and_spaced_accents_are_read(spark):
    docs = spark.createDataFrame([(i, "la crème brûlée est stupide et l'élève aussi ") for i in range(40)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.character_model(docs))
    assert r.restore(pa.array(["é l è v e"])) == ["élève"]
    noise = "".join(random.Random(1).choice("ab01.-$") for _ in range(20_000))  # linear in its length
    assert len(r.restore(pa.array([noise]))[0]) <= 20_000


def test_batches_do_not_change_readings(characters):
    texts = ["aab", "bbcc d", "ee", "e iddiiott", "x", "xx i d i o t", "t"]
    r = toxicity.Restorer(characters)
    assert r.restore(pa.array(texts)) == [r.restore(pa.array([t]))[0] for t in texts]


def test_decoding_finds_the_best_reading():
    rng = np.random.default_rng(10)
    model = np.log(rng.dirichlet(np.ones(28), (28, 28)))
    from itertools import product

    lattices = [toxicity.lattice(w) for w in ("a1b", "l0o3", "x.y", "aaab", "1*", "i$$$$d10t", "iddiiott", "@$$", "a" + "o" * 90 + "1")]
    for steps in [*lattices, toxicity.apart(list("yo1ab"), [1, 1, 2, 1])]:
        best = math.inf
        for choice in product(*steps):
            x = y = 0
            cost = sum(c for _, c in choice)
            for ch in "".join(t for t, _ in choice):
                s = ord(ch) - 96 if "a" <= ch <= "z" else 0 if ch == " " else 27
                cost -= model[x, y, s]
                x, y = y, s
            best = min(best, cost - model[x, y, 0])
        assert abs(toxicity.best_reading(steps, model)[1] - best) < 1e-9


def test_toxicity(spark, empty):
    docs, labels = _labelled(spark, grades=2)
    model, characters = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, characters).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].predicted == i % 2 for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[300].score == got[301].score
    disguised = spark.createDataFrame([(1, "f1ne"), (2, "pl@in"), (3, "f i n e")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(disguised, model, characters).orderBy("doc_id").collect()] == [1, 0, 1]
    assert toxicity.score(empty, model, characters).count() == 0
