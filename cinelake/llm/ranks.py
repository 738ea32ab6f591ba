"""Dense positions of rows in the order of each group, also for groups with a large share of all rows.

Rows are dealt by ranges of (group, order), so that a hot group takes as many tasks as its rows need, and numbered inside each range. Ranges and groups are then counted (a row for
each run: as many as ranges and groups together), a running sum over a group's runs gives the offset of each, and one join adds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cinelake.llm.store import Workspace


def _numbered(batches: Iterable[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row in its run of equal groups; runs go over borders of batches."""
    last, place = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(group)
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        goes_on = keys[0].as_py() == last
        starts = np.flatnonzero(new)
        at = np.arange(batch.num_rows)
        local = at - starts[np.cumsum(new) - 1]
        if goes_on:
            local[: starts[1] if len(starts) > 1 else len(local)] += place
        last, place = keys[-1].as_py(), int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "place_"])


def ranked(rows: DataFrame, group: str, order: list[str], space: Workspace, name: str) -> DataFrame:
    """The rows with `idx` (from 0, in the order of `order` within the group) and `n` (rows of the group). `group` is a string and never NULL; ties in `order` get any order."""
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("run_", F.spark_partition_id())
    placed = space.write(sorted_.mapInArrow(lambda batches: _numbered(batches, group), f"{sorted_._jdf.schema().toDDL()}, place_ long"), name)
    runs = placed.groupBy(group, "run_").agg(F.count("*").alias("rows_"))
    w = Window.partitionBy(group)
    before = F.sum("rows_").over(w.orderBy("run_").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(group, "run_", F.coalesce(before, F.lit(0)).alias("before_"), F.sum("rows_").over(w).alias("n"))
    return placed.join(runs, [group, "run_"]).withColumn("idx", F.col("before_") + F.col("place_")).drop("run_", "place_", "before_")
