"""Numpy work on bounded groups of rows, without a Python call per row or a data frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


GROUP = "__group"


def map_groups(df: DataFrame, keys: Sequence[str], order: str, fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None], outputs: str,
               keep: Sequence[str] | None = None, together: bool = False) -> DataFrame:
    """Apply `fn` to the columns of each group of `keys`, ordered by `order`; its result columns get the `keep` keys (all by default) in front.

    Rows are shuffled by key and sorted inside the partition, so groups lie next to each other: batches are cut at group
    edges and only one unfinished group is carried over. Groups must be bounded by the caller's keys.

    With `together`, `fn` gets the rows of all groups of a batch at once, with GROUP, the number of each row's group (ascending from 0), and gives GROUP back for each row of its result: many small groups
    cost no call each.
    """
    keys = list(keys)
    keep = keys if keep is None else list(keep)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join([f"`{k}` {types[k]}" for k in keep] + [outputs])
    names = [part.split()[0].strip("`") for part in outputs.split(",")]

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        new[:1] = True
        for k in keys:
            v, w = pdf[k].iloc[1:], pdf[k].iloc[:-1].set_axis(pdf.index[1:])
            new[1:] |= ((v != w) & ~(v.isna() & w.isna())).to_numpy()
        return np.flatnonzero(new)

    def apply(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame | None:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns if c not in keys or c == order}
        if together:
            out = fn(columns | {GROUP: np.repeat(np.arange(len(edges)), np.diff([*edges, len(pdf)]))})
            if out is None or not len(out[GROUP]):
                return None
            at = np.asarray(edges)[out[GROUP]]
            return pd.DataFrame({k: pdf[k].to_numpy()[at] for k in keep} | {n: out[n] for n in names})
        results, rows = [], []
        for s, e in zip(edges, [*edges[1:], len(pdf)]):
            out = fn({c: v[s:e] for c, v in columns.items()})
            if out is not None and len(out[names[0]]):
                results.append(out)
                rows.append((s, len(out[names[0]])))
        if not results:
            return None
        at = np.repeat([s for s, _ in rows], [n for _, n in rows])
        frame = {k: pdf[k].to_numpy()[at] for k in keep}
        frame.update({n: np.concatenate([r[n] for r in results]) for n in names})
        return pd.DataFrame(frame)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pd.concat([*carried, pdf], ignore_index=True) if carried else pdf.reset_index(drop=True)
            edges = starts(pdf)
            cut = edges[-1]
            if cut:
                out = apply(pdf.iloc[:cut], edges[:-1])
                if out is not None:
                    yield out
            carried = [pdf.iloc[cut:].reset_index(drop=True)]
        if carried:
            out = apply(carried[0], np.zeros(1, int))
            if out is not None:
                yield out

    # a fixed number: numpy work is heavy for its bytes, and adaptive execution would put small inputs into one task
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, order).mapInPandas(run, ddl)
