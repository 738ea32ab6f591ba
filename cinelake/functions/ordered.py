"""Running values over one key that may hold a large share of all rows.

A window partitioned by the key alone would pull a hot key into one task. These helpers cut each key into blocks of
consecutive ordinals, so a task holds at most `block` rows of a key at once: block totals are aggregated first (with
map-side combine), the few totals are scanned per key, and the rows are finished inside their block. The ordinal must be
an integer that is unique within the key; pre-aggregate by (key, ordinal) when it is not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cinelake.functions import grouped
from cinelake.session import checkpointed

BLOCK = 1 << 16
BLOCK_COLUMN = _BLK = "__ordered_block"


def with_block(df: DataFrame, ordinal: str, block: int = BLOCK) -> DataFrame:
    return df.withColumn(_BLK, F.floor(F.col(ordinal) / F.lit(block)).cast("long"))


def _join_blocks(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Block-level values back to the rows. Plain equality lets the window that follows reuse the join's partitioning; a NULL
    key finds no block, which the callers turn into an error."""
    return rows.join(side.withColumn("__found", F.lit(True)), [*keys, _BLK], "left")


def _checked(value: Column) -> Column:
    return F.when(F.col("__found").isNull(), F.raise_error(F.lit("running values need keys and ordinals that are not NULL"))).otherwise(value)


def scan(df: DataFrame, keys: Sequence[str], ordinal: str, sums: dict[str, Column | str] | None = None,
         carries: dict[str, tuple[Column, bool]] | None = None, block: int = BLOCK, inclusive: bool = False) -> DataFrame:
    """Running totals and carried values of one key order in one pass: one aggregate over blocks, one join, one window.

    `sums` maps a name to the value totalled over earlier rows (up to and with the row itself if `inclusive`); `carries`
    maps a name to (value, skip_nulls): the value of the row before, or of the last earlier row where it is not NULL.
    The input is read twice (block facts, rows): checkpoint it first when it is itself the result of a scan.
    """
    sums, carries = sums or {}, carries or {}
    rows = with_block(df, ordinal, block)
    zero = F.lit(0).cast("long")
    facts, bases, drops = [], [], [_BLK, "__found", "__first"]
    by_block = W.partitionBy(*keys).orderBy(_BLK)
    before = by_block.rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, _BLK).orderBy(ordinal)
    for n, value in sums.items():
        rows = rows.withColumn(f"__v_{n}", F.coalesce((F.col(value) if isinstance(value, str) else value).cast("long"), zero))
        facts.append(F.sum(f"__v_{n}").alias(f"__t_{n}"))
        bases.append(F.coalesce(F.sum(f"__t_{n}").over(before), zero).alias(f"__b_{n}"))
    for n, (value, skip) in carries.items():
        rows = rows.withColumn(f"__v_{n}", value)
        seen = F.col(f"__v_{n}").isNotNull() if skip else F.lit(True)
        facts.append(F.max_by(f"__v_{n}", F.when(seen, F.col(ordinal))).alias(f"__t_{n}"))
        bases.append((F.last(f"__t_{n}", ignorenulls=True).over(before) if skip else F.lag(f"__t_{n}").over(by_block)).alias(f"__b_{n}"))
    totals = rows.groupBy(*keys, _BLK).agg(*facts)
    out = _join_blocks(rows, totals.select(*keys, _BLK, *bases), keys)
    if any(not skip for _, skip in carries.values()):
        out = out.withColumn("__first", F.row_number().over(inside) == 1)
    for n in sums:
        local = F.sum(f"__v_{n}").over(inside.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
        out = out.withColumn(f"__l_{n}", F.coalesce(local, zero))
    for n, (_, skip) in carries.items():
        local = F.last(f"__v_{n}", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)) if skip else F.lag(f"__v_{n}").over(inside)
        out = out.withColumn(f"__l_{n}", local)
    result = {n: F.col(f"__b_{n}") + F.col(f"__l_{n}") for n in sums}
    for n, (_, skip) in carries.items():
        result[n] = F.coalesce(f"__l_{n}", f"__b_{n}") if skip else F.when(F.col("__first"), F.col(f"__b_{n}")).otherwise(F.col(f"__l_{n}"))
    for n, value in result.items():
        out = out.withColumn(n, _checked(value))
        drops += [f"__v_{n}", f"__b_{n}", f"__l_{n}"]
    return out.drop(*drops)


def running_sum(df: DataFrame, keys: Sequence[str], ordinal: str, sums: dict[str, Column | str], block: int = BLOCK, inclusive: bool = False) -> DataFrame:
    return scan(df, keys, ordinal, sums=sums, block=block, inclusive=inclusive)


def previous_value(df: DataFrame, keys: Sequence[str], ordinal: str, value: Column, name: str, block: int = BLOCK, skip_nulls: bool = False) -> DataFrame:
    return scan(df, keys, ordinal, carries={name: (value, skip_nulls)}, block=block)


def row_index(df: DataFrame, keys: Sequence[str], ordinal: str, name: str, block: int = BLOCK) -> DataFrame:
    """0-based dense position within the key."""
    return running_sum(df, keys, ordinal, {name: F.lit(1)}, block)


def two_pass(rows: DataFrame, keys: Sequence[str], ordinal: str, facts: Callable[[dict], dict], facts_ddl: str, link: Callable[[DataFrame], DataFrame], finish: Callable[[dict, dict], dict | None],
             out_ddl: str, block: int = BLOCK) -> DataFrame:
    """A fold along each key in blocks of ordinals, in numpy where rows of several kinds have to be matched in order.

    `facts` sums up each block on its own (one row of `facts_ddl` for each, in their order); `link` turns these few rows into what each block enters with, with windows over a key's blocks; `finish` gets
    the blocks' rows with their entries (arrays over blocks, NaN for NULL where a column has any), and gives the result. Both get the rows of many blocks at once, with the number of the block in grouped.GROUP, as keys can be
    many and small; blocks are numbered from 0, and results name theirs. The input is evaluated once and written; a block, at most `block` ordinals of a key, is what a task holds. Blocks for which `link` has no row are left out.
    """
    keys = list(keys)

    def summed(g: dict) -> dict:
        return facts(g) | {grouped.GROUP: np.arange(g[grouped.GROUP][-1] + 1)}

    held = checkpointed(rows.withColumn(_BLK, F.floor(F.col(ordinal) / F.lit(block)).cast("long")))
    entries = link(checkpointed(grouped.map_groups(held, [*keys, _BLK], ordinal, summed, facts_ddl, together=True)))
    names = [c for c in entries.columns if c not in (*keys, _BLK)]
    typed = {f.name: f.dataType for f in held.schema}
    lead = entries.select(*keys, _BLK, *names, F.lit(True).alias("__entry"), *[F.lit(None).cast(t).alias(c) for c, t in typed.items() if c not in (*keys, _BLK, ordinal)], (F.col(_BLK) * block - 1).cast(typed[ordinal]).alias(ordinal))
    body = held.select("*", F.lit(False).alias("__entry"), *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in names])

    def run(g: dict) -> dict | None:
        lead, group = g["__entry"].astype(bool), g[grouped.GROUP]
        if not lead.any():
            return None
        known = group[lead]  # blocks with an entry; one each
        entry = {c: g[c][lead] for c in names}
        mine = ~lead & np.isin(group, known)
        rest = {c: v[mine] for c, v in g.items() if c not in names and c not in ("__entry", grouped.GROUP)}
        out = finish(rest | {grouped.GROUP: np.searchsorted(known, group[mine])}, entry) if mine.any() else None
        return None if out is None else out | {grouped.GROUP: known[out[grouped.GROUP]]}

    return grouped.map_groups(body.unionByName(lead), [*keys, _BLK], ordinal, run, out_ddl, keep=keys, together=True)
