"""The training-data pipeline over `documents`: each stage reads what the one before it kept.

quality (3) drops documents that the ordinal classifier rejects; near_dedup (6) keeps one document of each group; passages (8) cuts passages that repeat earlier documents; decontaminate
(1) drops documents that hold benchmark windows; encode (5) gives the piece ids of each text that is left. NULL texts pass all stages (they have nothing to judge but the classifier's
prior) and get no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinelake.llm import decontaminate, near_dup, ordinal, pieces, substring
from cinelake.llm.queries import vocabulary
from cinelake.llm.store import Workspace


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ordinal.select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_passages(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(docs, vocabulary())
    return encoded.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids")


STAGES = [("quality", _quality), ("near_dedup", _near_dedup), ("passages", _passages), ("decontaminate", _decontaminate), ("encode", _encode)]

#: SQL can express neither the classifier's fit nor the stages after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.write(docs, name)
            if i:
                space.drop(STAGES[i - 1][0])
    return docs
