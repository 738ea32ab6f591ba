"""Sharding by longest processing time: groups of equal texts, largest first, each to the least-loaded shard of a heap.

Groups of the same size are interchangeable, so the heap works on sizes: the least-loaded shards take the groups of one size in turn, and each
shard ends up with a range of ranks within that size. Only the histogram of sizes meets in one task; d different sizes take at least
d * (d + 1) / 2 bytes together, so it has at most sqrt(2 * all bytes) rows, and it is read as a stream. Everything else is keyed by text or spread
over buckets.

Law `bytes`: loads are those of the greedy rule, within the size of one group of each other. A group never leaves its shard, so a group of more than
an equal share makes its shard larger. Defined cases: a NULL text has no bytes and no checksum, and all NULL texts are one group; repeated rows and
repeated or NULL doc_ids are rows like others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 16
SPREAD = 64


def deal(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, number of groups), largest first, to (size, shard, first rank, rank after the last): what a heap of loads gives group by group.

    While a size has many groups, whole rounds are dealt at once: once loads are less than one group apart, each shard takes one group a round.
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        taken = dict.fromkeys(range(shards), 0)
        while count:
            if count >= shards and max(heap)[0] - heap[0][0] < size:
                rounds = count // shards
                heap = [(load + rounds * size, s) for load, s in heap]
                heapq.heapify(heap)
                for s in taken:
                    taken[s] += rounds
                count -= rounds * shards
            else:
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                taken[s] += 1
                count -= 1
        at = 0
        for s in sorted(taken):
            if taken[s]:
                yield size, s, at, at + taken[s]
                at += taken[s]


def _offsets(counts: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """For each key and bucket, how many rows of the key are in the buckets before; a key has as many rows here as there are buckets at most."""
    w = Window.partitionBy(*keys).orderBy(spread).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")))


def _bucket(of: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS, spread: int = SPREAD) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (NULL: this law has none), group_size."""
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("text_key"),
    )
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("group_size")).withColumn("cell", _bucket(F.col("text_key"), spread))
    cells = groups.groupBy("group_size", "cell").agg(F.count("*").alias("n"))

    def heap(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = deal(((int(s), int(n)) for b in batches for s, n in zip(b["group_size"], b["n"])), shards)
        while part := [r for _, r in zip(range(10_000), out)]:
            yield pd.DataFrame(part, columns=["group_size", "shard", "lo", "hi"])

    histogram = cells.groupBy("group_size").agg(F.sum("n").alias("n"))
    dealt = histogram.repartition(1).sortWithinPartitions(F.desc("group_size")).mapInPandas(heap, "group_size long, shard int, lo long, hi long")
    ranges = dealt.groupBy("group_size").agg(F.array_agg(F.struct("lo", "hi", "shard")).alias("ranges"))  # one per shard at most
    ranked = (
        groups.withColumn("local", F.row_number().over(Window.partitionBy("group_size", "cell").orderBy("text_key")) - 1)
        .join(_offsets(cells, ["group_size"], "cell"), ["group_size", "cell"])
        .join(ranges, "group_size")
        .withColumn("rank", F.col("before") + F.col("local"))
        .select("text_key", "group_size", F.filter("ranges", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]["shard"].alias("shard"))
    )
    placed = rows.join(ranked, "text_key").withColumn("cell", _bucket(F.struct("doc_id", "text_key"), spread * spread))
    before = _offsets(placed.groupBy("shard", "cell").agg(F.count("*").alias("n")), ["shard"], "cell").select("shard", "cell", "before")
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_key")) - 1 + F.col("before")
    return placed.join(F.broadcast(before), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "group_size",
    )
