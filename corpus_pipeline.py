"""A corpus pipeline of training-data operators.

Language identification drops what has no language, the n-gram join keeps one of each group of near duplicates,
surrogates replace personal data, and packing cuts what is left into training sequences. A stage takes (spark,
docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns of documents.
Null and empty texts have no language and go in the first stage; rows with null or repeated ids are rows of their own;
an empty table stays empty; further columns are handed on.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, langid, ngram_join, packing, queries, surrogates

#: Texts whose language is less sure than this are rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; the model learns from the labels of documents whose crc32(doc_id) mod 4 is not 2."""
    common.prepare(spark)
    model = langid.fit(docs, F.coalesce(common.crc_mod(docs["doc_id"], 4) != 2, F.lit(False)))
    return langid.keep_identified(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, the document with the smallest id."""
    common.prepare(spark)
    return ngram_join.keep_one(docs, ngram_join.Rule(words=5, num=80, den=100))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    common.prepare(spark)
    out = surrogates.replace(docs, queries.SURROGATE_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, 8 pieces and the attention cost of 1536 x 1024: one row per piece of at most 1024 tokens. Each of the three binds for some sequences."""
    common.prepare(spark)
    path = public_tokenizers.path
    limits = packing.Limits(tokens=2048, docs=8, attention=1536 * 1024, piece=1024)
    return packing.pack_documents(docs, limits, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Training a classifier and drawing surrogates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
