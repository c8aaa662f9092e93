"""One thin query for each training-data operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import attention_lm, audio, byte_bpe, common, cross_polytope, langid, ngram_join, packing, prefix_tokens, sharding, surrogates

#: Key of the surrogates; a deployment passes its own.
SURROGATE_KEY = "tracemill-demo-key"


def _held_out(m: int) -> F.Column:
    return F.coalesce(common.crc_mod(F.col("doc_id"), m) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = langid.fit(docs, F.coalesce(common.crc_mod(docs["doc_id"], 4) != 2, F.lit(False)))
    return langid.identify(docs, model).select("doc_id", _held_out(4).alias("held_out"), "lang_pred", "score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.store_texts(common.read_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(common.read_table(spark, sf_dir, "documents"), ngram_join.Rule(words=4, num=85, den=100))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes sa ON sa.doc_id = p.a JOIN sizes sb ON sb.doc_id = p.b WHERE 100 * p.same >= 85 * (sa.n + sb.n - p.same)
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id))::BIGINT AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.count_documents(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    trained = F.coalesce(common.crc_mod(docs["doc_id"], 7) != 2, F.lit(False))
    out = attention_lm.score_documents(docs, trained, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", _held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(common.read_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(common.read_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, key=SURROGATE_KEY, count_col="n_entities")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = packing.Limits(tokens=1024, docs=1024, attention=1024 * 1024)
    path = public_tokenizers.path
    docs = common.read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, limits, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_media_columns, op3_ngram_jaccard, op4_token_counts, op5_byte_bpe, op6_lm_scoring, op7_sharding, op8_nearest_neighbours, op9_pii, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": OP3_SQL}
