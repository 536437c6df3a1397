"""The ``opN_<name>`` queries: each applies its operator, with production
parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.llm import bpe, extract, flat_ids, jaccard, lines, mixing, pii, quality, repair, resample, rules, sql, topk, warc
from donorlens.llm.common import table

def held_out() -> Column:
    """Rows whose remainder of crc32(doc_id) by 3 is 1 do not train."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.NgramJaccardJoin(table(spark, sf_dir, "documents")).documents()


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "repeats", "copies")


def op4_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality.score(docs, weights)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents")))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "text", "n_removed_lines")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged_rows(table(spark, sf_dir, "conversations")))


def op13_flat_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_ids.read(spark, flat_ids.write(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pii_weak_supervision, op2_ngram_jaccard_join, op3_source_mixing, op4_warc_index_merge, op5_html_extraction,
    op6_quality_classifier, op7_byte_bpe, op8_exact_topk, op9_quality_rules, op10_line_dedup,
    op11_target_resampling, op12_conversation_repair, op13_flat_token_ids)}

#: DuckDB SQL of the queries that SQL can express.  The others (1, 3, 5, 6, 7, 13)
#: are held against brute-force versions by the tests.
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingles),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM shingles s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""

ORACLE_SQL["op4_warc_index_merge"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

ORACLE_SQL["op8_exact_topk"] = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY s.r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS h,
    len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT doc_id, source, unnest(l) AS x FROM w)),
hot AS (SELECT source, h FROM lines GROUP BY source, h HAVING count(DISTINCT doc_id) > 100),
lost AS (
  SELECT doc_id, sum(n) AS lost FROM lines JOIN hot ON lines.source IS NOT DISTINCT FROM hot.source AND lines.h = hot.h GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
  NOT base_failed AND NOT (n_removed_words * 100 > n_words * 50) AS kept
FROM judged
"""

ORACLE_SQL["op10_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS x FROM documents),
full_lines AS (
  SELECT doc_id, n, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS h,
    row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r, count(*) OVER (PARTITION BY doc_id) AS total
  FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
runs AS (
  SELECT doc_id, r, list(n) OVER w AS ns, list(h) OVER w AS hs, total FROM full_lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY r ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
windows AS (SELECT * FROM runs WHERE r <= greatest(total - 2, 1)),
later AS (
  SELECT doc_id, ns FROM (SELECT *, row_number() OVER (PARTITION BY hs ORDER BY doc_id, r) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(ns) AS n FROM later),
rest AS (
  SELECT l.doc_id, coalesce(string_agg(CASE WHEN gone.n IS NULL THEN x END, chr(10) ORDER BY l.n), '') AS text,
    CAST(count(gone.n) AS BIGINT) AS n_removed_lines
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.n = gone.n GROUP BY l.doc_id)
SELECT documents.doc_id, rest.text, coalesce(n_removed_lines, 0) AS n_removed_lines FROM documents LEFT JOIN rest USING (doc_id)
"""

ORACLE_SQL["op11_target_resampling"] = sql.TARGET_RESAMPLING
ORACLE_SQL["op12_conversation_repair"] = sql.CONVERSATION_REPAIR
