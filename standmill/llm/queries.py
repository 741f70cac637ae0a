"""The corpus queries by name, each over whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standmill.llm import ann_search, collocations, conversation_repair, hamming_search, html_content, language_id, ngram_join, packing, personal_data, piece_sampling, quality_rules, token_counts, toxicity
from standmill.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), seed=17)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_search.binary_codes(table(spark, sf_dir, "embeddings"))
    return hamming_search.top_k(codes, codes.filter("id % 50 = 0"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_search.nearest(vectors, F.col("vec_id") % 20 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_ngram_join, op3_html_content, op4_quality_rules, op5_toxicity, op6_token_counts, op7_piece_sampling, op8_packing, op9_hamming_search, op10_personal_data, op11_collocations, op12_ann_search, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.SQL, "op9_hamming_search": hamming_search.SQL, "op11_collocations": collocations.SQL}
