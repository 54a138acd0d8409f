"""A training-data pipeline over ``documents``: five stages, each one operator of ``plumbline.llm``.

Every stage works on all rows that the one before kept. A stage's result is written as Parquet in the shared folder
and read again as the next one's input, so a lost executor costs at most the stage in progress.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plumbline  # noqa: E402
from plumbline.llm import jaccard, mixing, packing, quality, secrets  # noqa: E402
from plumbline.llm.common import materialise  # noqa: E402
from plumbline.llm.queries import word_bpe  # noqa: E402

cloudpickle.register_pickle_by_value(plumbline)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return jaccard.one_per_component(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark, and their length anew."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document as often as it is drawn."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents of the mixture, and the sequence and place of each."""
    return packing.pack(docs, word_bpe(), end_id=1, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot express the mixture's draws or the packing; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
