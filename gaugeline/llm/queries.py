"""Queries and SQL of the corpus operators, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import crf_langid, kmeans_tree, licenses, near_dedup, packing, piece_codec, pii, prefix_trie, quality, runs, simhash, toxicity, url_trees
from gaugeline.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(rows)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_langid.predict(docs, crf_langid.fit(docs))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.with_shared_heads(prefix_trie.conversation_paths(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(paths).drop("digest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_url_filters, op2_packing, op3_pii, op4_language, op5_near_dedup, op6_fingerprints, op7_neighbours, op8_toxicity,
        op9_quality, op10_pieces, op11_runs, op12_licenses, op13_prefix_trie,
    )
    return {f.__name__: f for f in named}


#: Full shingle sets, pairs that share a shingle, and the closure of the links; for small tables only.
OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS v, doc_id AS root FROM sets
  UNION
  SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.v AND r.root < l.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT v, min(root) AS component_id FROM reach GROUP BY v) r ON r.v = s.doc_id
"""


#: Every prefix of every rebuilt conversation, and each node's sums by way of the prefixes of its least member.
#: The crc32 is that of the decimal conv_id, bit by bit.
OP13 = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
crcs AS (
  SELECT conv_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))) AS inverted
  FROM (SELECT DISTINCT conv_id FROM turns)),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS lender, xor(inverted, 4294967295) % 4 AS h FROM crcs),
lent AS (SELECT h.conv_id, t.n, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.lender AND t.n <= h.h),
rebuilt AS (
  SELECT * FROM lent
  UNION ALL
  SELECT t.conv_id, t.n - h.h + coalesce(k.m, 0), t.role, t.text FROM turns t JOIN heads h ON h.conv_id = t.conv_id AND t.n > h.h
    LEFT JOIN (SELECT conv_id, count(*) AS m FROM lent GROUP BY 1) k ON k.conv_id = t.conv_id),
paths AS (
  SELECT h.conv_id, coalesce(list(sha256(len(r.role) || ':' || r.role || r.text) ORDER BY r.n) FILTER (WHERE r.n IS NOT NULL), []) AS path,
    coalesce(list(len(list_filter(regexp_split_to_array(r.text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) ORDER BY r.n) FILTER (WHERE r.n IS NOT NULL), []) AS words
  FROM heads h LEFT JOIN rebuilt r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
prefixes AS (
  SELECT conv_id, depth, sha256(array_to_string(path[1:depth], ',')) AS node, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words, depth = len(path) AS last
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM paths)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
linked AS (
  SELECT n.*, p.node AS parent, u.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.node = p.node),
children AS (SELECT parent AS node, count(*) AS n FROM linked GROUP BY 1),
sums AS (
  SELECT a.node, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens
  FROM nodes d JOIN prefixes a ON a.conv_id = d.conv_id AND a.depth <= d.depth LEFT JOIN children c ON c.node = d.node GROUP BY a.node)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l LEFT JOIN children c ON c.node = l.node JOIN sums s ON s.node = l.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": OP5, "op13_prefix_trie": OP13}
