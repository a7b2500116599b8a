"""A training corpus from raw documents, stage by stage.

Every stage takes rows with the columns of documents and any others, null and empty texts,
repeated rows, very long texts and empty tables; what it does with each is stated here and
in the operator that it calls.  All but the last return the columns that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fitforge.llm import exactdup, ngramjoin, packing, privacy, resampling
from fitforge.llm.queries import VOCABULARY, surrogate_key
from fitforge.llm.scratch import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that resampling keeps.  Null and empty texts weigh nothing and are judged by their noise alone; repeated rows go together; no rows give none."""
    return resampling.keep_target_like(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text without white space; null and empty texts are one group, and rows that repeat a doc_id and its text stay together."""
    return exactdup.drop_exact_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of similar texts; rows without words or without doc_id all stay."""
    return ngramjoin.drop_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates in their texts; null stays null, and no row comes or goes."""
    return privacy.replace_entities(docs, surrogate_key(spark)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all rows; a null or empty text is one piece of its closing token, and repeated rows have pieces each."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", remove_exact_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("PII", replace_personal_data),
    ("best-fit packing", pack),
]

# Packing follows a heuristic over tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage_{k}")
    return docs
