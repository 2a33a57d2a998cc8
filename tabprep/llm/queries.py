"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tabprep.llm import (active_codes, binary_ids, forced_bpe, forest, grouping, heap_centroids, html, jaccard, licenses,
                         packing, pseudo_lm, quality, suffix)
from tabprep.queries.registry import table
from tabprep.sources.storage import fresh_path


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = binary_ids.write_token_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                        fresh_path(spark, "token-files"))
    return binary_ids.read_token_files(spark, path, with_ids=False)


def op2_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_table(table(spark, folder, "documents"))


def op3_template_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_texts(table(spark, folder, "pages"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, folder, "documents"), with_text=False)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_components(table(spark, folder, "documents")).drop("class_id")


def op7_forced_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return forced_bpe.encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                        with_ids=False)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op9_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_lm.score(table(spark, folder, "documents"))


def op10_tree_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op11_linear_grouping(spark: SparkSession, folder: str) -> DataFrame:
    return grouping.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op12_active_codes(spark: SparkSession, folder: str) -> DataFrame:
    return active_codes.compress(table(spark, folder, "embeddings")).drop("label")


def op13_heap_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return heap_centroids.cluster_vectors(table(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_quality_cascade, op3_template_extraction, op4_suffix_dedup, op5_license_scan, op6_ngram_jaccard,
    op7_forced_bpe, op8_packing, op9_pseudo_likelihood, op10_tree_forest,
    op11_linear_grouping, op12_active_codes, op13_heap_centroids)} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {"op2_quality_cascade": quality.QUALITY_SQL, "op12_active_codes": active_codes.CODES_SQL,
                       "op13_heap_centroids": heap_centroids.CLUSTERS_SQL}
