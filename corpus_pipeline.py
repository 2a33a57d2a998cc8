"""A corpus from documents to packed sequences: quality rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import jaccard, packing, quality, suffix
from tabprep.llm.arrow import plain
from tabprep.llm.rows import numbered_rows, unused
from tabprep.sources.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group that five-word shingles link at 0.8 or more."""
    return jaccard.keep_smallest(docs, width=5, p=80, q=100)


def whole_characters(kept: bytes, spans: list[list[int]]) -> str:
    """Text of the kept bytes without the characters that a removed span's ends break."""
    parts, at, removed = [], 0, 0
    for low, high in spans:
        parts.append(kept[at:low - removed])
        at, removed = low - removed, removed + high - low
    return "".join(part.decode("utf-8", "ignore") for part in [*parts, kept[at:]])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of earlier passages; characters that a cut breaks go, n_chars follows, empty texts go.

    Rows with a null id come first of all and keep it; rows that repeat an id are documents of their own.
    """
    row, cut_row, cut_text = (unused(name, docs) for name in ("row", "cut_row", "cut_text"))
    numbered = numbered_rows(docs, row)
    cut = suffix.remove_repeats(numbered, row).where("n_removed > 0").select(
        F.col("doc_id").alias(cut_row), F.udf(whole_characters, "string")("kept", "spans").alias(cut_text))
    joined = numbered.join(cut, F.col(row) == F.col(cut_row), "left")
    text = F.when(F.col(cut_row).isNotNull(), F.col(cut_text)).otherwise(F.col("text"))
    return (joined.withColumn("text", text).where("text <> ''").withColumn("n_chars", F.length("text").cast("long"))
            .select(*map(plain, docs.columns)))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages), ("packing", packed_sequences)]

#: Tokens of a vocabulary file are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
