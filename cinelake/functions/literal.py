"""Dimension tables made from constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_ROWS = 10_000


def small_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A table of constants, marked for broadcast up to MAX_ROWS rows: a table from constants has no statistics, and
    without the mark a join would shuffle the large side, contents included. A larger one is left to the optimizer."""
    table = spark.createDataFrame(list(rows), ddl)
    return F.broadcast(table) if len(rows) <= MAX_ROWS else table
