"""Connected components of a table of links by alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond").

Each step is a grouped minimum and one join, written to the shared folder, until the links are stars around each component's smallest id. The number of steps grows with the
logarithm of the links. Nothing is collected but a count and a checksum for each step; a hub with very many links is
a skewed join key, which adaptive execution splits: minima are written first, so that both sides of a join are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.llm.store import Workspace


def _large_star(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = space.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = space.write(down.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """links (a, b) of longs, a <> b, to (id, component): the smallest id that each linked id reaches. Ids without links are not in the result."""
    current = space.write(_small_star(links, space, f"{name}-0-least"), f"{name}-0")
    state, step = _state(current), 0
    while True:
        step += 1
        now, last = f"{name}-{step}", f"{name}-{step - 1}"
        large = space.write(_large_star(current, space, f"{now}-least-large"), f"{now}-large")
        after = space.write(_small_star(large, space, f"{now}-least"), now)
        space.drop(last, f"{last}-least", f"{now}-least-large", f"{now}-large")
        before, state, current = state, _state(after), after
        if state == before:
            space.drop(f"{now}-least")
            return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
