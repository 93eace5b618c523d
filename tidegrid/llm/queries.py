"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, ctw, fingerprint, jaccard, merkle, packing, pieces, repeats, token_files, topk, toxicity, turns, url_filter
from tidegrid.llm.staging import shared_uri
from tidegrid.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset-hash fingerprints of texts and of their edited texts."""
    return fingerprint.edit_report(_table(spark, sf_dir, "documents"))


@_query(
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """
)
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest inner products of every fiftieth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents."""
    return packing.digests(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1))


@_query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids through Arrow files."""
    folder = shared_uri(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    # the manifest is written once: reading it again must not write the shards again
    manifest = cut_lineage(token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2))
    return token_files.read(manifest, folder)


@_query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and the texts decoded from them."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@_query(
    """
    WITH u AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    j AS (
      SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
    """
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest rule for every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules, ["page_id"])


@_query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by three-word shingles at 0.9."""
    return jaccard.join_components(_table(spark, sf_dir, "documents"))


@_query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


@_query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 400-byte strings that also start elsewhere."""
    return repeats.report(_table(spark, sf_dir, "documents"))


@_query()
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree weighting scores of all texts."""
    return ctw.score_texts(_table(spark, sf_dir, "documents"))


#: crc32 of ASCII text: bitwise steps over its bytes, as the engine of the checks has no such function.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substring({0}, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


@_query(
    f"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    hit AS (SELECT *, {CRC32.format("k")} % 20 AS h FROM keyed),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
             CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM hit, (VALUES (1), (2)) c(copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
    shown AS (
      SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen, left(role, 1) AS letter,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS times,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
    rows AS (
      SELECT *, CASE WHEN seen = '' THEN 'b' WHEN times > 1 THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM shown),
    counts AS (
      SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (before || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
    follows(state, letter, into_state) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
    -- up to two inserted turns
    filled(state, into_state, letters, lines) AS (
      SELECT state, state, '', '' FROM (VALUES ('0'), ('s'), ('u'), ('a')) s(state)
      UNION ALL SELECT state, into_state, 'I', CASE letter WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END FROM follows WHERE letter <> 's'
      UNION ALL SELECT a.state, b.into_state, 'II', CASE a.letter WHEN 'u' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END
      FROM follows a JOIN follows b ON a.into_state = b.state AND a.letter <> 's'),
    moves(state, letter, into_state, edit, cost, role) AS (
      SELECT state, NULL::VARCHAR, state, 'D', 2, NULL::VARCHAR FROM (VALUES ('0'), ('s'), ('u'), ('a')) s(state)
      UNION ALL SELECT state, letter, into_state, 'K', 0, NULL FROM follows
      UNION ALL SELECT state, NULL, into_state, 'R', 1, CASE letter WHEN 'u' THEN 'user' ELSE 'assistant' END FROM follows WHERE letter <> 's'),
    walk(conv_id, i, state, cost, audit, lines) AS (
      SELECT conv_id, 0::BIGINT, '0', 0::BIGINT, '', '' FROM counts
      UNION ALL
      SELECT conv_id, i, state, cost, audit, lines FROM (
        SELECT w.conv_id, r.i, m.into_state AS state,
               w.cost + 5 * length(f.letters) + m.cost + CASE WHEN r.fault = 't' AND m.edit <> 'D' THEN 5 ELSE 0 END AS cost,
               w.audit || f.letters || m.edit AS audit,
               w.lines || f.lines || CASE WHEN m.edit = 'D' THEN '' ELSE chr(10) || coalesce(m.role, r.role) || ':' || r.text END AS lines,
               row_number() OVER (PARTITION BY w.conv_id, m.into_state ORDER BY
                 w.cost + 5 * length(f.letters) + m.cost + CASE WHEN r.fault = 't' AND m.edit <> 'D' THEN 5 ELSE 0 END, w.audit || f.letters || m.edit) AS best
        FROM walk w JOIN rows r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1
        JOIN filled f ON f.state = w.state JOIN moves m ON m.state = f.into_state
        WHERE (m.edit = 'D' OR r.fault NOT IN ('b', 'd')) AND (m.edit <> 'K' OR m.letter = r.letter)) WHERE best = 1),
    done AS (
      SELECT w.conv_id, w.cost + 5 * length(f.letters) AS cost, w.audit || f.letters AS audit, w.lines || f.lines AS lines,
             row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 5 * length(f.letters), w.audit || f.letters) AS best
      FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
      JOIN filled f ON f.state = w.state AND f.into_state IN ('0', 'a'))
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substring(lines, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a
    LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON a.conv_id IS NOT DISTINCT FROM d.conv_id AND d.best = 1
    """
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    return turns.report(_table(spark, sf_dir, "conversations"))


@_query()
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids and the texts decoded from them."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field(text)})"


@_query(
    f"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, lang, {_leaf("text")} AS leaf,
             CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 3 = 0
               THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS tampered FROM documents),
    placed AS (
      SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
    nodes(tree, level, idx, n, digest) AS (
      SELECT tree, 0, idx, n, leaf FROM placed
      UNION ALL
      SELECT tree, any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, idx // 8),
    subroots AS (SELECT tree, level, digest FROM nodes WHERE n = 1),
    upper_nodes(level, idx, n, digest) AS (
      SELECT 0, tree, (SELECT count(*) FROM subroots), digest FROM subroots
      UNION ALL
      SELECT any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper_nodes WHERE n > 1 GROUP BY idx // 8),
    root AS (SELECT digest FROM upper_nodes WHERE n = 1),
    -- the siblings left and right of each node, levels of the upper tree behind those of the group's tree
    steps AS (
      SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lhs,
             coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rhs
      FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL),
    upper_steps AS (
      SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lhs,
             coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rhs
      FROM upper_nodes a JOIN upper_nodes b ON a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL),
    proofs AS (
      SELECT p.tree, p.idx, s.level, s.lhs, s.rhs FROM placed p JOIN steps s ON p.tree = s.tree AND s.idx = p.idx // CAST(power(8, s.level) AS BIGINT)
      UNION ALL
      SELECT p.tree, p.idx, 1000 + s.level, s.lhs, s.rhs FROM placed p JOIN upper_steps s ON s.idx = p.tree // CAST(power(8, s.level) AS BIGINT)),
    listed AS (SELECT tree, idx, list({{'lhs': lhs, 'rhs': rhs}} ORDER BY level) AS steps FROM proofs GROUP BY tree, idx),
    folded AS (
      SELECT p.*, coalesce(l.steps, []) AS steps,
             list_reduce(list_prepend({{'lhs': '', 'rhs': tampered}}, coalesce(l.steps, [])), lambda d, s: {{'lhs': '', 'rhs': sha256(s.lhs || d.rhs || s.rhs)}}).rhs AS folded_root
      FROM placed p LEFT JOIN listed l USING (tree, idx))
    SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(array_to_string(list_transform(steps, lambda x: x.lhs || x.rhs), '')) AS proof_sha256,
           folded_root, folded_root = r.digest AS verified
    FROM folded f JOIN subroots s ON f.tree = s.tree, root r
    """
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, a third of them tampered with."""
    return merkle.tamper_report(_table(spark, sf_dir, "documents"))
