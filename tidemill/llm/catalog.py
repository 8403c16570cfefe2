"""Registered queries of the training-text operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import byte_bpe, language_id, merkle, packing, quality_ranker, sharding, simhash, sphere_filters, suffix_dedup, topk_nra, toxicity, turn_repair, url_filter

#: The rules that the URL query applies.
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sphere_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sphere_filters.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_k(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle_to_shards(_table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_ranker.fit(docs, _table(spark, sf_dir, "labels"), ~quality_ranker.held_out("doc_id"))
    scored = quality_ranker.score(docs, model)
    return scored.select(
        "doc_id",
        quality_ranker.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = byte_bpe.decode(coded, ranks)
    return both.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(merkle.document_leaves(_table(spark, sf_dir, "documents")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.col("evidence.example").alias("evidence"),
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(_table(spark, sf_dir, "conversations")))


def _crc32(s: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string, which DuckDB lacks; 3988292384 is its fixed polynomial."""
    return f"""xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ord({s}[i])::BIGINT)),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
              lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf(text: str) -> str:
    """SQL for the digest of a document's fields."""
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')" for x in fields) + ")"


QUERIES = {
    "op1_sphere_filters": op1_sphere_filters,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_topk_nra": op3_topk_nra,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_quality_ranker": op8_quality_ranker,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES = {
    "op1_sphere_filters": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
          WHERE embedding IS NOT NULL AND label IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (
          SELECT u AS s, u AS t FROM links
          UNION
          SELECT r.s, l.w FROM reach r JOIN links l ON l.u = r.t),
        low AS (SELECT s, min(t) AS c FROM reach GROUP BY s),
        n AS (SELECT u, count(*) AS k FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, coalesce(low.c, e.vec_id) AS component_id,
               e.vec_id = coalesce(low.c, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN low ON low.s = e.vec_id""",
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (
          SELECT doc_id, s, doc_id::HUGEINT * 10000000000 + s AS place, substr(h, 2 * s + 1, 200) AS k
          FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS s FROM d WHERE length(h) >= 200)),
        later AS (
          SELECT doc_id, s FROM w JOIN (SELECT k, min(place) AS earliest FROM w GROUP BY k HAVING count(*) > 1) USING (k)
          WHERE place > earliest),
        marked AS (
          SELECT doc_id, s, CASE WHEN s - 100 <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM later),
        numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM marked),
        spans AS (SELECT doc_id, n, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, n),
        edges AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
        cut AS (
          SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS ending,
            string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
          FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
          coalesce(n_spans, 0)::BIGINT AS n_spans,
          sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(ending, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op3_topk_nra": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_url_filter": """
        WITH rules(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
          ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        parts AS (
          SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        hits AS (
          SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS verdict
          FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
          GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN hits USING (page_id)""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE given AS (
          SELECT *, CASE WHEN {_crc32('s')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found
          FROM (SELECT *, doc_id::VARCHAR AS s FROM documents)),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos,
            row_number() OVER () AS k
          FROM (SELECT doc_id, source, {_leaf('text')} AS node, {_leaf('found')} AS now FROM given)),
        low AS (
          SELECT source, 0 AS depth, pos, node, count(*) OVER (PARTITION BY source) AS n FROM leaves
          UNION ALL
          SELECT source, depth + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1
          GROUP BY source, depth, pos // 3, n),
        subroots AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM low WHERE n = 1),
        high AS (
          SELECT 0 AS depth, pos, node, count(*) OVER () AS n FROM subroots
          UNION ALL
          SELECT depth + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1
          GROUP BY depth, pos // 3, n),
        steps AS (
          SELECT k, 0 AS tree, depth, string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.at) AS l, string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.at) AS r
          FROM (SELECT k, source, depth, pos // (3 ** depth)::BIGINT AS at FROM leaves, generate_series(0, 30) AS g(depth)) a
          JOIN low b USING (depth) WHERE b.n > 1 AND a.source IS NOT DISTINCT FROM b.source AND b.pos // 3 = a.at // 3 GROUP BY k, depth
          UNION ALL
          SELECT k, 1, depth, string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.at), string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.at)
          FROM (SELECT k, depth, s.pos // (3 ** depth)::BIGINT AS at FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, generate_series(0, 30) AS g(depth)) a
          JOIN high b USING (depth) WHERE b.n > 1 AND b.pos // 3 = a.at // 3 GROUP BY k, depth),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tree, depth) AS i FROM steps),
        fold AS (
          SELECT k, 0::BIGINT AS i, now AS node FROM leaves
          UNION ALL
          SELECT k, s.i, sha256(coalesce(l, '') || f.node || coalesce(r, '')) FROM fold f JOIN numbered s USING (k) WHERE s.i = f.i + 1),
        proofs AS (SELECT k, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY i)) AS proof FROM numbered GROUP BY k)
        SELECT a.doc_id, a.node AS leaf, s.node AS subroot, h.node AS root, coalesce(proof, sha256('')) AS proof_sha256,
          f.node AS folded_root, f.node = h.node AS verified
        FROM leaves a JOIN subroots s ON a.source IS NOT DISTINCT FROM s.source JOIN high h ON h.n = 1 LEFT JOIN proofs USING (k)
          JOIN (SELECT k, arg_max(node, i) AS node FROM fold GROUP BY k) f USING (k)""",
    "op13_turn_repair": f"""
        WITH RECURSIVE given AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
        hit AS (SELECT *, {_crc32('s')} % 20 AS h FROM given),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
            CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit),
        numbered AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS stem, left(role, 1) AS c FROM damaged),
        judged AS (
          SELECT *, CASE WHEN stem = '' THEN 'b'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
            WHEN right(stem, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault,
            lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS odd FROM numbered),
        counted AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
            count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
            count(*) FILTER (odd) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
        -- The cheapest edits of the first i turns by the state they end in: 0 nothing yet, 1 after s, 2 after a, 3 after u.
        steps AS (
          SELECT conv_id, n, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS said FROM counted
          UNION ALL
          SELECT conv_id, n, i, state, least.cost, least.audit, least.said FROM (
            SELECT conv_id, n, i, state, min({{'cost': cost, 'audit': audit, 'said': said}}) AS least FROM (
              WITH ready AS (
                SELECT conv_id, n, i, state, cost, audit, said FROM steps WHERE i < n
                UNION ALL
                SELECT conv_id, n, i, CASE state WHEN 3 THEN 2 ELSE 3 END, cost + 5, audit || 'I',
                  said || CASE state WHEN 3 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END FROM steps WHERE i < n)
              SELECT r.conv_id, r.n, j.i, CASE op WHEN 'D' THEN state WHEN 's' THEN 1 ELSE CASE state WHEN 3 THEN 2 ELSE 3 END END AS state,
                cost + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 't' THEN 5 ELSE 0 END AS cost,
                audit || CASE op WHEN 's' THEN 'K' ELSE op END AS audit,
                said || CASE op WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || CASE state WHEN 3 THEN 'assistant:' ELSE 'user:' END || j.text
                  ELSE chr(10) || j.role || ':' || j.text END AS said
              FROM ready r JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.i = r.i + 1, (VALUES ('D'), ('K'), ('R'), ('s')) AS ops(op)
              WHERE CASE op WHEN 'D' THEN true WHEN 'K' THEN fault IN ('-', 't') AND c = CASE state WHEN 3 THEN 'a' ELSE 'u' END
                WHEN 'R' THEN fault IN ('-', 't') AND c <> CASE state WHEN 3 THEN 'a' ELSE 'u' END
                ELSE fault IN ('-', 't') AND c = 's' AND state = 0 END)
            GROUP BY conv_id, n, i, state)),
        ended AS (
          SELECT conv_id, min({{'cost': cost + CASE state WHEN 3 THEN 5 ELSE 0 END, 'audit': audit || CASE state WHEN 3 THEN 'I' ELSE '' END,
              'said': said || CASE state WHEN 3 THEN chr(10) || 'assistant:' ELSE '' END}}) AS least
          FROM steps WHERE i = n AND state <> 1 GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
          coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(least.cost, 0)::BIGINT AS cost,
          coalesce(least.audit, '') AS audit, sha256(coalesce(least.said, '')[2:]) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
          LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
