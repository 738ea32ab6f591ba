"""Interaction of filters, from truth-table survival words.

Each document becomes a 32-bit word: bit S says that it survives the subset S of the five filters (bit i of S: filter i is applied). A carry-save adder tree counts every bit position of many
words at once, per part and label, so that 32 subset counts per part are all that leaves a batch. Every question about any order of the filters is then a difference of
two of these counts: what an order keeps after a step is the count of the subset applied so far.

Filters A to D are column functions of the text. E (identical to the text of a smaller doc_id, anywhere in the table) needs one shuffle of digests: the least id of each
text, joined back on (text, id), so that a large group of copies spreads over its ids.

Defined cases: a NULL text is empty, and equal to other empty ones; a NULL source is the part of the empty string; a row with a NULL doc_id neither is an earlier copy nor has one, and has no
labels; repeated rows of one id and text are no copies of each other and count each; an id that is labelled more than once has a label if any of its rows has; no rows, no parts. A very
long text is handled whole, in one row; other columns of the documents are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cinelake.llm.store import Workspace

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
_BLANK = r"[ \t\n\x0B\f\r]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Survival word of each failure mask: bit S is set where no failed filter is in S.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def positional_popcounts(words: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """How many words of each group have each of the 32 bits set, [groups, 32].

    Carry-save: three words of one weight become one of the same weight (the sum without carries) and one of twice the weight (the carries), for all bit positions and groups together, until
    each group has at most one word of each weight: the binary digits of its counts.
    """
    totals = np.zeros((groups, 32), np.int64)
    bits = np.arange(32, dtype=np.uint32)
    order = np.argsort(group, kind="stable")
    group, words, weight = group[order], words[order], 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g, w = (np.concatenate(x) for x in zip(*parts))
        at = np.argsort(g, kind="stable")
        return g[at], w[at]

    while len(words):
        carries = []
        while True:
            counts = np.bincount(group, minlength=groups)
            starts = np.cumsum(counts) - counts
            size = 3 if (counts > 2).any() else 2
            taken = np.arange(len(words)) - starts[group] < counts[group] // size * size
            if not taken.any():
                break
            g, columns = group[taken][::size], words[taken].reshape(-1, size).T
            if size == 3:
                a, b, c = columns
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
            else:
                a, b = columns
                total, carry = a ^ b, a & b
            carries.append((g, carry))
            group, words = merged([(g, total), (group[~taken], words[~taken])])
        totals[group] += ((words[:, None] >> bits) & np.uint32(1)).astype(np.int64) << weight
        group, words = merged(carries) if carries else (group[:0], words[:0])
        weight += 1
    return totals


def failures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, failed (bits of filters A to D), text_key (digest of the text)."""
    text = F.coalesce("text", F.lit(""))
    parts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.filter(F.split(text, f"{_BLANK}+"), lambda w: w != "").alias("words"))
    n, chars = F.size("words").cast("long"), F.char_length("text").cast("long")
    conditions = [
        n < 200,
        100 * F.size(F.array_distinct("words")).cast("long") < 50 * n,
        100 * (chars - F.char_length(F.translate("text", _CAPITALS, ""))) > 2 * chars,
        F.col("text").rlike("[#$%&*|]"),
    ]
    failed: Column = F.lit(0)
    for i, condition in enumerate(conditions):
        failed = failed + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    return parts.select("doc_id", "part", failed.alias("failed"), F.unhex(F.sha2("text", 256)).alias("text_key"))


def survival(docs: DataFrame, labels: DataFrame, space: Workspace) -> DataFrame:
    """Per row: part, failed (bits of all five filters), good, toxic."""
    rows = space.write(failures(docs), "failures")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(firsts, ["text_key", "doc_id"], "left").join(marks, "doc_id", "left").select(
        "part", (F.col("failed") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))).alias("failed"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


LABELS = ("all", "good", "toxic")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = batch.column("part").dictionary_encode()
        of, words = part.indices.to_numpy(), SURVIVAL[batch.column("failed").to_numpy()]
        groups, rows = [of * 3], [words]
        for i, label in enumerate(LABELS[1:], 1):
            has = batch.column(label).to_numpy(zero_copy_only=False)
            groups.append(of[has] * 3 + i)
            rows.append(words[has])
        counts = positional_popcounts(np.concatenate(rows), np.concatenate(groups), 3 * len(part.dictionary)).reshape(len(part.dictionary), 3, SUBSETS)
        columns = [pa.ListArray.from_arrays(np.arange(0, len(counts) * SUBSETS + 1, SUBSETS, dtype=np.int32), pa.array(counts[:, i].ravel())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([part.dictionary, *columns], names=["part", *LABELS])


def subset_survivors(rows: DataFrame) -> DataFrame:
    """Per part: the 32 numbers of rows that survive each subset, of `all` rows and of those labelled `good` and `toxic`."""
    counted = rows.mapInArrow(_count, "part string, " + ", ".join(f"`{label}` array<long>" for label in LABELS))
    sums = [F.expr(f"array({', '.join(f'sum(`{label}`[{i}])' for i in range(SUBSETS))})").alias(label) for label in LABELS]
    return counted.groupBy("part").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order (every order of the filters) and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = subset_survivors(survival(docs, labels, Workspace(docs.sparkSession, "audit")))
    others = len(FILTERS) - 1

    def shapley(i: int) -> str:
        """What filter i removes, over all orders: before it stand the filters of s in any order, after it the rest in any order."""
        before = [s for s in range(SUBSETS) if not s >> i & 1]
        return " + ".join(f"{factorial(s.bit_count()) * factorial(others - s.bit_count())} * (`all`[{s}] - `all`[{s | 1 << i}])" for s in before)

    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = counts.select("*", F.expr(f"array({', '.join(map(shapley, range(len(FILTERS))))})").alias("values"), orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - 65)"
    before = F.expr(f"aggregate(transform(sequence(1, {len(FILTERS)}), i -> if(i < step, {bit.format('i')}, 0)), 0, (a, b) -> a + b)")
    placed = steps.withColumns({"before": before, "own": F.expr(bit.format("step"))}).withColumn("after", F.expr("before + own"))

    def lost(label: str) -> Column:
        return F.col(label)[F.col("before")] - F.col(label)[F.col("after")]

    whole = F.lit(SUBSETS - 1)
    return placed.select(
        "part", "filter_order", "step", F.col("all")[F.col("after")].alias("kept"), lost("all").alias("removed"),
        (F.col("all")[0] - F.col("all")[F.col("own")] - lost("all")).alias("redundant"), (F.col("all")[whole - F.col("own")] - F.col("all")[whole]).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("values")[F.expr("ascii(substr(filter_order, step, 1)) - 65")].alias("shapley"),
    )
