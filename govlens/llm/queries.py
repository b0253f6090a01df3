"""The registered queries of the training-data operators: thin uses of them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.llm import ctw, decontam, langid, linededup, minhash, packing, prefixtrie, quality, ring, spelling, streamdedup, toxicity, urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file that the queries tokenize with; it lies at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_certified_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model, characters = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, characters)


def op3_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.dedup(read(spark, sf_dir, "documents")).drop("keep_file", "keep_block")


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op6_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read(spark, sf_dir, "documents"))


def op7_content_defined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.dedup(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "removed_chunks", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(read(spark, sf_dir, "documents"), shards=24)


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_url_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.rule_table(spark))


def op11_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read(spark, sf_dir, "documents"))


def op12_adaptive_radix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(read(spark, sf_dir, "conversations"))


def op13_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


QUERIES = {
    "op1_certified_best_fit": op1_certified_best_fit,
    "op2_noisy_channel_toxicity": op2_noisy_channel_toxicity,
    "op3_wand_decontamination": op3_wand_decontamination,
    "op4_streaming_exact_dedup": op4_streaming_exact_dedup,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_context_tree_weighting": op6_context_tree_weighting,
    "op7_content_defined_lines": op7_content_defined_lines,
    "op8_bounded_load_ring": op8_bounded_load_ring,
    "op9_circulant_minhash": op9_circulant_minhash,
    "op10_url_expressions": op10_url_expressions,
    "op11_trie_frontier": op11_trie_frontier,
    "op12_adaptive_radix_trie": op12_adaptive_radix_trie,
    "op13_ftrl_language": op13_ftrl_language,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 by its table of 256 values; the text's characters are below U+0800.
_CRC_TABLE = "SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"


def _crc(s: str) -> str:
    utf8 = f"flatten(list_transform(string_split({s}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + ord(x) % 64] END))"
    return f"xor(list_reduce(list_concat([4294967295], {utf8}::BIGINT[]), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"


ORACLE = {
    "op11_trie_frontier": f"""
        WITH RECURSIVE z AS ({_CRC_TABLE}),
        r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
        o AS (SELECT k, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY k, w),
        h AS (SELECT w, n, {_crc("k || w")} AS h FROM o, z),
        c AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(n)::BIGINT AS n
              FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
        d AS (SELECT word, n, 0 AS i, word AS v FROM c UNION ALL SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS i FROM c)),
        p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM d a JOIN d b ON a.v = b.v AND a.word <> b.word WHERE a.i = b.i OR a.i = 0 OR b.i = 0),
        f AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near COLLATE "C") AS near, max(m) AS m FROM p GROUP BY word),
        g AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * c.n THEN near END AS form, CASE WHEN m >= 5 * c.n THEN m END AS form_n FROM c LEFT JOIN f USING (word)),
        s(word, last, form) AS (SELECT word, word, form FROM g UNION ALL SELECT s.word, g.word, g.form FROM s JOIN g ON g.word = s.form)
        SELECT g.word, g.form, s.last AS root, n, n_near, form_n FROM g JOIN s ON s.word = g.word AND s.form IS NULL""",
    "op12_adaptive_radix_trie": f"""
        WITH z AS ({_CRC_TABLE}),
        o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {_crc("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), z),
        t AS (SELECT c.conv_id, 0 AS own, o.* EXCLUDE conv_id FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND k <= h
              UNION ALL SELECT c.conv_id, 1, o.* EXCLUDE conv_id FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
        s AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY own, k) AS turns, list(length(text) ORDER BY own, k) AS sizes FROM t GROUP BY conv_id),
        b AS (SELECT conv_id, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM c LEFT JOIN s USING (conv_id)),
        m AS (SELECT conv_id, d, array_to_string(turns[1:d], '') AS node, array_to_string(turns[1:d - 1], '') AS up, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, len(turns) = d AS ends
              FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM b)),
        n AS (SELECT node, d AS depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS cost,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, d),
        k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
        e AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.node),
        w AS (SELECT DISTINCT a.node, x.node AS below, x.cost, x.n_children FROM m a JOIN m y ON y.conv_id = a.conv_id AND y.d >= a.d JOIN e x ON x.node = y.node),
        u AS (SELECT node, sum(cost)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM w GROUP BY node)
        SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, e.ends_sha256
        FROM e JOIN u ON u.node = e.node LEFT JOIN e p ON e.depth > 0 AND p.node = e.up""",
    "op9_circulant_minhash": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (
          SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
        c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN c USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_streaming_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_url_expressions": f"""
        WITH u AS (
          SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
        p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                           ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (SELECT p.*, action, rhost || rpath AS rule,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
              FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1""",
}
