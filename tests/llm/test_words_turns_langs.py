"""Spelling variants, the prefix trie and language ID against brute force on small tables, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from govlens.llm import langid, prefixtrie, spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n, times):
    near_words = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near_words.items()}
    form = {w: v if v and n[v] >= times * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near_words[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(3)
    base = ["".join(rng.choice("abàÿé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    some = []
    for w in base:
        for _ in range(rng.randint(1, 4)):
            i, x = rng.randrange(len(w)), rng.choice("abzß")
            some.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + x + w[i:], w[:i] + x + w[i + 1 :], w + x, x + w, w]))
    long = "q" * 2000
    texts = [" ".join(rng.choice(base + base + some) for _ in range(60)) for _ in range(40)]
    texts += [f"{long} {long}q {long}Q {long[:-1]}r" for _ in range(6)] + [None, "", "short", "ABCDEFÀ abcdefà Ābcdefg漢abcdef", texts[0], texts[0]]
    return [*enumerate(texts), (3, texts[3]), (None, texts[4]), (None, texts[4])]


def test_spelling_variants(spark, spelled):
    want = Counter()
    for i, t in spelled:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 19 == 0 else w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert len({len(w) for w in want}) > 4 and max(map(len, want)) > 2000
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in spelled], "doc_id long, text string, word string, n long, form int").repartition(3)
    got = spelling.group(docs, drop=19, times=2).collect()
    assert {tuple(r) for r in got} == variants(want, 2) and len(got) == len(want)
    assert sum(r.form is not None for r in got) > 5
    assert spelling.group(docs.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet, size, words", [("ab", 7, 60), ("abc", 4, 80), ("a", 9, 9)])
def test_neighbours_are_all_pairs_one_edit_apart(spark, alphabet, size, words):
    rng = random.Random(size)
    own = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, size))) for _ in range(words)} | {"", "b"}
    got = spelling.neighbours(spark.createDataFrame([(w,) for w in own], "word string")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in own for b in own if a != b and near(a, b))


def trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple((r, x) for *_, r, x in sorted(turns.get(c - c % 100, []))[:h] + sorted(turns[c])[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, q in built.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    for q in members:
        if q:
            kids[q[:-1]].append(q)
    leaves, saved = {}, {}
    for q in sorted(members, key=len, reverse=True):
        leaves[q] = sum(leaves[k] for k in kids[q]) or 1
        saved[q] = sum(saved[k] for k in kids[q]) + ((len(members[q]) - 1) * len(q[-1][1]) if q else 0)
    digest = {q: hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == q))).encode()).hexdigest() for q, m in members.items()}
    return [(min(m), len(q), min(members[q[:-1]]) if q else None, len(m), len(kids[q]), leaves[q], saved[q], digest[q]) for q, m in members.items()]


def turns_of(seed):
    """Few different turns, so that conversations branch and repeat; nulls, repeated rows, one very common and one very long conversation."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(100, 160), 305, 307, 1000, 1001]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé", "漢字"])) for t in range(rng.randint(1, 4))]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 480) for t in range(3)]
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 2, "user", None), (8, 2, "user", None), (None, 1, "user", "x")]
    rows += [(c, t, "user", "long") for c in (900, 901, 1002) for t in range(400)]
    return rows


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[:2], r[3:]))


@pytest.mark.parametrize("keys", [3, 100_000])
def test_prefix_trie(spark, monkeypatch, keys):
    one = prefixtrie._trees
    monkeypatch.setattr(prefixtrie, "_trees", lambda width: (setattr(prefixtrie, "TREE_KEYS", keys), one(width))[1])
    rows = turns_of(keys)
    frame = spark.createDataFrame([(*r, 1, "d") for r in rows], "conv_id long, turn long, role string, text string, n long, depth string").repartition(5)
    assert in_order(prefixtrie.trie(frame).collect()) == in_order(trie(rows))
    prefixtrie.TREE_KEYS = 100_000


def test_prefix_trie_without_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefixtrie.trie(spark.createDataFrame([], kind)).count() == 0
    # a conversation that takes nothing from its absent base and has no turn after its first h
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = prefixtrie.trie(spark.createDataFrame([(alone, 0, "user", "x")], kind)).collect()
    assert [tuple(r) for r in got] == trie([(alone, 0, "user", "x")]) and got[0].depth == 0


@pytest.mark.parametrize("children", [3, 4, 5, 16, 17, 48, 49, 256])
def test_layouts_of_a_node(children):
    rng = random.Random(children)
    order = rng.sample(range(256), children)
    node, put = prefixtrie.Node(b""), {}
    for x in order:
        put[x] = prefixtrie.Node(bytes([x]))
        node.put(x, put[x])
        assert all(node.get(y) is c for y, c in put.items())
    assert node.room == next(r for r in (4, 16, 48, 256) if children <= r)
    assert [c.prefix[0] for c in node.below()] == sorted(order)
    assert all(node.get(y) is None for y in range(256) if y not in put)
    again = prefixtrie.Node(b"new")
    node.put(order[0], again)
    assert node.get(order[0]) is again and len(node.below()) == children


def test_tree_of_random_keys():
    rng = random.Random(1)
    keys = sorted({b"".join(bytes([rng.choice((0, 1, 255)), rng.randrange(3)]) for _ in range(rng.randint(0, 4))) for _ in range(80)})
    nodes = prefixtrie.summarise(keys, [1] * len(keys), list(range(len(keys))), [[1] * (len(k) // 2) for k in keys], 2)
    want = Counter(k[:d] for k in keys for d in range(0, len(k) + 1, 2))
    assert Counter({keys[x[0]][: x[1] * 2]: x[2] for x in nodes}) == want and len(nodes) == len(want)
    for x in nodes:
        if x[1]:
            assert keys[nodes[x[8]][0]][: nodes[x[8]][1] * 2] == keys[x[0]][: x[1] * 2 - 2]


def test_ngrams_keep_to_their_text():
    texts = ["ab", None, "", "é漢😀 A9", "ab", "x" * 5000, "a\tb ", "Ab"]
    feats, at = langid.grams(pa.array(texts, pa.string()))
    sizes = [sum(max(0, len(t or "") - k + 1) for k in langid.SIZES) for t in texts]
    assert np.diff(at).tolist() == sizes
    own = [feats[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)]
    assert own[0] == own[4] == own[7] and len(set(own[5])) == 3
    alone = [langid.grams(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert own == alone


def test_ftrl_is_the_update_rule():
    rng = np.random.default_rng(2)
    model, z, n = langid.Ftrl(6, 3), np.zeros((6, 3)), np.zeros((6, 3))
    for _ in range(40):
        at, x, right = np.sort(rng.choice(6, 3, replace=False)), rng.normal(size=3), int(rng.integers(3))
        w = [[0.0 if abs(z[i, k]) <= model.l1 else -(z[i, k] - np.sign(z[i, k]) * model.l1) / ((model.beta + n[i, k] ** 0.5) / model.alpha + model.l2) for k in range(3)] for i in range(6)]
        e = [np.exp(sum(w[i][k] * v for i, v in zip(at, x, strict=True))) for k in range(3)]
        for k in range(3):
            for i, v in zip(at, x, strict=True):
                g = (e[k] / sum(e) - (k == right)) * v
                sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / model.alpha
                z[i, k] += g - sigma * w[i][k]
                n[i, k] += g * g
        model.learn(at, x, right)
        assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert (model.weights(slice(None)) == 0).any()


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(3)
    true = rng.normal(size=(3000, 4)) * 2
    right = np.array([rng.choice(4, p=p) for p in langid.softmax(true)])
    assert abs(langid.temperature(true * 3, right) - 3) < 0.4
    assert langid.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0
    sure = np.eye(3)[[0, 1, 2, 0]] * 10
    assert langid.temperature(sure, np.array([0, 1, 2, 0])) > 1


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id: r.held_out for r in got} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got} and len(got) == docs.count()
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    kind = "doc_id long, text string, lang string, source string, score double, held_out string"
    rows = [(i, t, lang, "s", 9.0, "h") for i, (t, lang) in enumerate([("the house and the tree", "en"), ("das Haus und der Baum", "de")] * 30)]
    edge = [(100, None, "en"), (101, "", "de"), (102, "123 !?", None), (None, "the tree", "en"), (103, "der Baum " * 20_000, None), (104, "the and the", None), (104, "the and the", None), (105, "漢字", None)]
    docs = spark.createDataFrame(rows + [(i, t, lang, "s", 9.0, "h") for i, t, lang in edge], kind).repartition(3)
    model = langid.train(docs)
    out = langid.predict(docs, model)
    got = out.filter("doc_id >= 100 or doc_id is null").collect()
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == 8 and model.langs == ["de", "en"]
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "de", "en"] and by[100].score == 0 and by[None].held_out is False
    assert by[105].lang_pred in model.langs
    # neither the language nor the source of a scored row tells anything
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'t' as source")
    assert sorted(map(str, langid.predict(other, model).collect())) == sorted(map(str, out.collect()))
    nothing = langid.train(docs.limit(0))
    assert langid.predict(docs.limit(0), nothing).count() == 0 and {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
