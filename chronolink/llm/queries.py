"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolink.llm import ann, bpe, line_dedup, lm, mixing, pu_classifier, quality_rules, sharding, simhash, substring_dedup
from chronolink.llm.common import read

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), vocabulary_path(), ids=False, digests=True)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 16)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_classifier.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), 50, digests=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_nearest, op3_line_dedup, op4_simhash, op5_sharding, op6_quality_rules, op7_pu_classifier, op8_lm, op9_substring_dedup, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest": OP2_SQL, "op9_substring_dedup": OP9_SQL, "op10_mixing": OP10_SQL}


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || doc_id::VARCHAR) AS ord FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
-- level: target = least(3 * size, level * weight); levels by sources in order of 3 * size / weight
o AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS full_at,
         sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS w_left
  FROM s),
l AS (SELECT max(CASE WHEN (total - used) / w_left <= full_at THEN (total - used) / w_left END) AS level FROM o),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, level * w) AS target FROM o, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS words,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, words // source_size) ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, words - epochs * source_size - start)))::BIGINT AS taken,
       -- stretches of 4096-word blocks that the copies meet
       list_sum(list_transform([0, 1, 2], lambda c: CASE WHEN least(start + c * source_size + size, words) > start + c * source_size
         THEN (least(start + c * source_size + size, words) - 1) // 4096 - (start + c * source_size) // 4096 + 1 ELSE 0 END))::BIGINT AS n_pieces
FROM e
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.embedding) = len(q.embedding) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p0, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, p0, md5(array_to_string(ws[p0:p0 + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
g AS (SELECT h.doc_id, list(h.p0) AS starts FROM h JOIN m USING (k) WHERE h.doc_id > m.first GROUP BY h.doc_id),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(x, x + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS x FROM g)) GROUP BY doc_id),
p AS (SELECT w.doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w JOIN c USING (doc_id)),
f AS (
  SELECT p.doc_id, list(p.ws[p.i] ORDER BY p.i) FILTER (WHERE x.p IS NULL) AS kept
  FROM p LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM c) x ON x.doc_id = p.doc_id AND x.p = p.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(len(c.gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN c.doc_id IS NULL THEN array_to_string(w.ws, ' ') ELSE coalesce(array_to_string(f.kept, ' '), '') END) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""
