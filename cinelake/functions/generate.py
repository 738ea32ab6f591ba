"""Row generation from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions import rational

BLOCK = 1 << 16


def expand(df: DataFrame, count: Column, name: str, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """`count` rows per input row, numbered 0.. in column `name`; rows without a count vanish.

    A single count may stand for a large share of all output rows, so it is first cut into blocks, the (still few) blocks
    are spread over tasks, and only then expanded.
    """
    zero = F.lit(0).cast("long")
    blocks = df.withColumn("__n", count.cast("long")).where("__n > 0").withColumn(
        "__blk", F.explode(F.sequence(zero, rational.int_div(F.col("__n") - 1, F.lit(block)))))
    spread = blocks.repartition(*[F.col(c) for c in by], F.col("__blk"))
    first = F.col("__blk") * block
    return spread.withColumn(name, F.explode(F.sequence(first, F.least(F.col("__n"), first + block) - 1))).drop("__n", "__blk")
