"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept. All but the last return the columns of `documents`; the last one returns the pieces of
documents with their place in sequences. Every stage but the near-copy join works row by row where the text is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factlode.llm import decontaminate, jaccard, language_id, packing, pii, rows
from factlode.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; a null text, or one without letters, has none."""
    return language_id.keep_identified(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of a test item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data replaced by the name of its kind, and counts characters anew."""
    columns = docs.columns
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    return packing.pack_documents(docs, rows.tokenizer_path(), window=1024)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage), ("near_copies", near_copy_stage), ("decontamination", decontamination_stage), ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express hyperdimensional profiles, alignments or online packing; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the output of each is written to the shared checkpoint folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
