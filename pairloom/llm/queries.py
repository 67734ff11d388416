"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import (
    centroids, decontam, embeddings, lm, packing, perspectives, privacy, quality, resampling, simhash, tokens, toxicity, urls,
)
from pairloom.llm.common import read

QUERIES = {}
CHECKS: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.judge(read(spark, sf_dir, "pages"), rules)


CHECKS["op5_url_filters"] = """
WITH rests AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
judged AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""


@query
def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(read(spark, sf_dir, "conversations"))


CHECKS["op7_chat_perspectives"] = """
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM said WHERE speaker <> 'system'),
shown AS (
  SELECT s.conv_id, participant, turn, speaker, text AS content,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN speaker NOT IN ('system', participant) THEN speaker END AS name
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
heads AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' ||
    regexp_replace(replace(name, '<|', '< |'), '[\r\n]', ' ', 'g'), '') || chr(10) AS head FROM shown),
segments AS (
  SELECT *, head || replace(content, '<|', '< |') || '<|im_end|>' || chr(10) AS text FROM heads),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, (sum(length(text)) OVER w)::BIGINT AS stop FROM segments
  WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, content
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, participant, position, turn, speaker, role, name, text, stop - length(text) AS start, stop,
       CASE WHEN role = 'assistant' THEN stop - length(text) + length(head) END AS loss_start,
       CASE WHEN role = 'assistant' THEN stop END AS loss_stop
FROM placed"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(read(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), TOKENIZER)


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


@query
def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(read(spark, sf_dir, "documents"))


CHECKS["op12_personal_data"] = r"""
WITH patterns(rank, kind, pattern) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (2, 'card', '[0-9](?:[ -]?[0-9])+'), (3, 'phone', '\+[0-9][ ().0-9-]+[0-9]')),
docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT k, rank, kind, regexp_extract_all(text, pattern) AS matches, string_split_regex(text, pattern) AS pieces
  FROM docs, patterns),
rows AS (
  SELECT k, rank, kind, unnest(matches) AS value, unnest(pieces[:len(matches)]) AS before, unnest(pieces[2:]) AS after,
         unnest(range(len(matches))) AS n FROM cut WHERE len(matches) > 0),
placed AS (
  SELECT *, (sum(length(before) + length(value)) OVER (PARTITION BY k, rank ORDER BY n))::BIGINT AS stop,
         regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM rows),
valid AS (
  SELECT *, stop - length(value) AS start FROM placed
  WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3
                                   OR try_cast(ltrim(x, '0') AS INTEGER) > 255)) = 0
    ELSE length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
      CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INTEGER
           ELSE 2 * digits[length(digits) - i]::INTEGER // 10 + 2 * digits[length(digits) - i]::INTEGER % 10 END)) % 10 = 0 END),
mentions AS (
  SELECT k, kind || ' ' || CASE kind WHEN 'email' THEN translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                           WHEN 'ip' THEN value ELSE digits END AS entity,
         CASE WHEN length(before) > 200 THEN regexp_replace(right(before, 200), '^[\p{L}\p{N}]+', '') ELSE before END || ' ' ||
         CASE WHEN length(after) > 200 THEN regexp_replace(left(after, 200), '[\p{L}\p{N}]+$', '') ELSE after END AS context
  FROM valid),
near AS (
  SELECT DISTINCT k, entity, unnest(regexp_extract_all(translate(regexp_replace(context, pattern, ' ', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+')) AS term
  FROM mentions, patterns WHERE rank = 0),
met AS (
  SELECT entity, term, count(*) AS n_both FROM near JOIN docs USING (k)
  WHERE length(term) >= 3 AND regexp_matches(term, '\p{L}') GROUP BY ALL HAVING count(DISTINCT text) >= 3),
entities AS (SELECT entity, count(DISTINCT k) AS n_c FROM mentions GROUP BY entity),
blanked AS (
  SELECT k, text, CASE WHEN len(matches) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(pieces) + 1),
    lambda i: pieces[i] || coalesce(repeat(' ', length(matches[i])), '')), '') END AS bare
  FROM docs JOIN cut USING (k) WHERE rank = 0),
words AS (
  SELECT k, unnest(regexp_extract_all(bare, '[\p{L}\p{N}]+')) AS word,
         unnest((string_split_regex(bare, '[\p{L}\p{N}]+'))[:len(regexp_extract_all(bare, '[\p{L}\p{N}]+'))]) AS before,
         unnest(range(len(regexp_extract_all(bare, '[\p{L}\p{N}]+')))) AS n FROM blanked),
stops AS (
  SELECT k, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, length(word) AS size,
         (sum(length(before) + length(word)) OVER (PARTITION BY k ORDER BY n))::BIGINT AS stop FROM words),
counts AS (SELECT term, count(DISTINCT k) AS n_t FROM stops GROUP BY term),
revealing AS (
  SELECT term, max(1 - ln(greatest(n_t / n_both, 1.0)) / ln(n / n_c)) AS share
  FROM met JOIN entities USING (entity) JOIN counts USING (term), (SELECT count(*)::DOUBLE AS n FROM docs)
  WHERE n_c < n GROUP BY term HAVING share >= 0.95),
spans AS (
  SELECT k, start, rank, stop, kind FROM valid
  UNION ALL SELECT k, stop - size, CASE WHEN share >= 0.98 THEN 4 ELSE 5 END, stop, CASE WHEN share >= 0.98 THEN 'term' ELSE 'general' END
  FROM stops JOIN revealing USING (term)),
spelt AS (
  SELECT k, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4), '') AS base,
         count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card,
         count(*) FILTER (rank = 3) AS n_phone FROM spans GROUP BY k)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN spelt USING (k)"""
