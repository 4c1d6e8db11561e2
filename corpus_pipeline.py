"""The corpus pipeline: quality, near copies, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next stage's documents. All stages but the last return the columns of documents, further
ones included. Every row is a document: null texts and ids, repeated rows, empty tables and texts of
any length pass through all stages as each one's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import mixing, near_copies, packing, quality, secret_scan
from seqloom.plans.lineage import checkpoint_folder

#: No SQL expresses the classifier or the packing; tests/llm compares with brute force instead.
ORACLE_SQL = None


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are probably of the grade wanted; fitted on rated documents of ``docs``.

    Null and empty texts are judged as texts without words; equal texts go or stay together.
    """
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_on(docs, ratings, F.expr(quality.LABEL_GRADE))
    return quality.select_quality(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-copy class, and all documents without words."""
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets inside texts; no document goes, null texts stay null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order; those without words are not taken."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences, each copy of a document by itself."""
    return packing.pack_pieces(packing.token_pieces(docs))


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what is between them lies in the checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
