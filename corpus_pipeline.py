"""A training-data pipeline over documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run``
writes each stage's rows to the shared folder and reads them as the next one's docs.

1. language_id: documents in no language go (texts without letters, and such with few of the languages' n-grams).
2. line_dedup: lines found in three documents or more stay in the last of them only.
3. near_dedup: of each group of documents linked by similarity 0.8 of five-word shingles, the one with the least doc_id stays.
4. mixing: documents come as often as their source's target weight takes them; sources over their target lose documents.
5. packing: what is left is packed into sequences of at most 1024 tokens, a row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import language_id, line_dedup, mixing, packing, similar
from textquarry.llm.common import stored


def accept_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduped_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.deduped_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", accept_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Not to be said in SQL: the model, the fingerprints and the packing. The stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
