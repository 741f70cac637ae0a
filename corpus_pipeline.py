"""Corpus pipeline: language ID, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents;
the last returns the packed pieces. Between stages the rows are written as Parquet and read again.

Defined results: a document with a null or empty text, or one without letters, has no language and goes in the first
stage; very long texts count whole in every stage; of documents whose overlaps link them, of exact copies and of rows of
one id one row stays, that of the smallest id (of several rows of that id the least text's, null first); rows without an id
are never duplicates;
an empty table goes through every stage as an empty one; further columns, whatever their names, are carried on unchanged.
Each operator's docstring has the ties.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standmill.llm import language_id, ngram_join, packing, personal_data, toxicity
from standmill.llm.common import carried, restored, table, written

#: A language that is less likely than this is rejected, like an undetermined one.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a likely language."""
    scored = language_id.predict(docs, language_id.fit(docs), carry=True)
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return restored(scored.filter(known), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return restored(toxicity.score(docs, index, carry=True).filter("predicted = 0"), docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id."""
    found = written(ngram_join.near_duplicates(docs))
    dropped = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    rows = kept.join(repeated, "doc_id", "left_semi").select("doc_id", F.col("text"), carried(docs))
    least = F.min_by(F.struct("text", "kept"), F.struct("text", F.xxhash64(F.to_json("kept")))).alias("least")
    once = restored(rows.groupBy("doc_id").agg(least).select("least.*"), docs)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return personal_data.mask(docs, personal_data.trusted_patterns(personal_data.graph(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", keep_known_language),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_group),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: No SQL: models are learned, and texts are tokenised. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
