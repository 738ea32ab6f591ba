"""Bounded samples of labelled rows, chosen by a hash of the id, so that they are the same in every run and spread over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def training_ids(labels: DataFrame, column: str, per_value: int, values: list[int], skip_fold: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, value, rank) of at most `per_value` labelled ids of each value; rank counts from 1 in hash order.

    skip_fold (m, r) leaves out ids whose crc32(id as text) mod m is r. An id that is labelled more than once takes its largest value; rows with a NULL
    id or label are left out. The result has per_value * len(values) rows at most.
    """
    rows = labels.select("doc_id", F.col(column).cast("int").alias("value")).where("doc_id IS NOT NULL AND value IS NOT NULL")
    if skip_fold:
        rows = rows.where(fold("doc_id", skip_fold[0]) != skip_fold[1])
    rows = rows.groupBy("doc_id").agg(F.max("value").alias("value")).withColumn("order_", F.xxhash64("doc_id", F.lit(7)))
    parts = [rows.where(F.col("value") == v).orderBy("order_", "doc_id").limit(per_value) for v in values]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("doc_id", "value", "order_")


def fold(column: str, m: int):
    """crc32 of the id as text, modulo m; a NULL id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % m, F.lit(0))
